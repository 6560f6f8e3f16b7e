"""Queries on logits: distillation by row and over all, and how evenly a router deals tokens to experts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import IGNORED, ce_row, distillation, kl_row, log_softmax, scaled
from ..plans.registry import query

#: Embeddings are taken for logits: times SHARP, the teacher's in reverse order.
SHARP, TEMPERATURE, ALPHA, EXPERTS = 40.0, 2.0, 0.7, 8
_SOFT = "list_transform({a}, lambda x: x - (list_max({a}) + ln(list_sum(list_transform({a}, lambda y: exp(y - list_max({a})))))))"
_AT = lambda e, by: f"list_transform({e}, lambda x: x::DOUBLE * {by})"
_ROWS = f"""l AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN {IGNORED} ELSE (vec_id % 64)::INT END AS y, {_AT('embedding', SHARP / TEMPERATURE)} AS s, {_AT('list_reverse(embedding)', SHARP / TEMPERATURE)} AS t, {_AT('embedding', SHARP)} AS h FROM embeddings),
m AS (SELECT vec_id, y, {_SOFT.format(a='s')} AS s, {_SOFT.format(a='t')} AS t, {_SOFT.format(a='h')} AS h FROM l),
r AS (SELECT vec_id, y, list_sum(list_transform(range(1, len(s) + 1), lambda i: exp(t[i]) * (t[i] - s[i]))) AS kl, CASE WHEN y <> {IGNORED} THEN -h[y + 1] END AS ce FROM m)"""


def _positions(t) -> DataFrame:
    e = F.col("embedding")
    y = F.when(F.col("vec_id") % 5 == 0, IGNORED).otherwise(F.col("vec_id") % 64).cast("int")
    logits, teacher = scaled(e, SHARP), scaled(F.reverse(e), SHARP)
    return t.embeddings.select("vec_id", y.alias("y"), kl_row(teacher, logits, TEMPERATURE).alias("kl"), ce_row(logits, y).alias("ce"))


@query("distill_rows", f"WITH {_ROWS} SELECT vec_id, round(kl, 6) + 0.0 AS kl, round(ce, 6) + 0.0 AS ce FROM r")
def distill_rows(t):
    return _positions(t).select("vec_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("kl", "ce")])


@query("distill_loss", f"WITH {_ROWS}, a AS (SELECT coalesce(avg(kl) FILTER (y <> {IGNORED}), 0) * {TEMPERATURE**2} AS kl, coalesce(avg(ce), 0) AS ce, count_if(y <> {IGNORED})::BIGINT AS n FROM r) SELECT round(kl, 6) AS kl, round(ce, 6) AS ce, round({ALPHA} * kl + {1 - ALPHA} * ce, 6) AS total, n FROM a")
def distill_loss(t):
    out = distillation(F.col("kl"), F.col("ce"), F.col("y"), TEMPERATURE, ALPHA)
    return _positions(t).agg(*[(c if k == "n" else F.round(c, 6)).alias(k) for k, c in out.items()])


def load_balance(df: DataFrame, logits: str, experts: int) -> DataFrame:
    """(loss, n): the number of experts times the sum, over experts, of the share of rows whose first choice it is and its
    mean probability; 1 if all are dealt alike. Sums are added up by row, so a row an expert is all that is gathered."""
    p = df.select(F.transform(log_softmax(F.col(logits)), lambda x: F.exp(x)).alias("p"))
    p = p.withColumn("first", F.array_position("p", F.array_max("p")))
    parts = [x for e in range(1, experts + 1) for x in (F.avg((F.col("first") == e).cast("double")).alias(f"f{e}"), F.avg(F.col("p")[e - 1]).alias(f"p{e}"))]
    total = sum((F.col(f"f{e}") * F.col(f"p{e}") for e in range(1, experts + 1)), F.lit(0.0))
    return p.agg(*parts, F.count("*").alias("n")).select((experts * total).alias("loss"), "n")


@query("load_balance", f"""WITH l AS (SELECT {_AT(f'embedding[1:{EXPERTS}]', SHARP)} AS a FROM embeddings), p AS (SELECT list_transform({_SOFT.format(a='a')}, lambda x: exp(x)) AS p FROM l),
q AS (SELECT p, list_position(p, list_max(p)) AS first FROM p), e AS (SELECT i, avg((first = i)::INT) AS f, avg(p[i]) AS m FROM q, range(1, {EXPERTS + 1}) r(i) GROUP BY 1)
SELECT round({EXPERTS} * sum(f * m), 6) AS loss, (SELECT count(*) FROM q) AS n FROM e""")
def load_balance_query(t):
    rows = t.embeddings.select(scaled(F.slice("embedding", 1, EXPERTS), SHARP).alias("logits"))
    return load_balance(rows, "logits", EXPERTS).select(F.round("loss", 6).alias("loss"), "n")
