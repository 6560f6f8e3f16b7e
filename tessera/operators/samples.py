"""Training samples: mixtures with bounded attempts, batches of like length, and checks on planted rows of every kind."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import char_tokens
from ..plans import transcripts as T
from ..plans.registry import query
from .sequence import global_index
from .training import IGNORED, MIXTURE, mask_audit


def _draw(name: str, i: Column) -> Column:
    """A number below 2^32 that name and i decide: the first eight hex digits of their MD5."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{name}:"), i.cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def mixture(spark, pools: dict[str, DataFrame], limits: list[tuple[str, float]], last: str, wanted: int, ahead: DataFrame, copies: int = 8, tries: int = 6) -> DataFrame:
    """(place, kind, id, attempt): a sample of wanted rows of several kinds, or fewer if tries * wanted attempts don't give
    so many. Each of ahead's ids comes first, copies times (attempt is null there), even if these are more than wanted.

    pools: kind -> (id, ok), ids without repeats. Attempt i draws a kind by the limits, the last beyond them, and one of
    its rows; it counts if the row is ok. All attempts are made at once, and the first that count are kept, so the result
    is that of making one after another until there are enough. A kind without rows gives none.
    """
    numbered, sizes = [], {}
    for kind, pool in pools.items():
        rows = global_index(pool.select("id", "ok"), "id", "pick").withColumn("kind", F.lit(kind))
        sizes[kind] = rows.count()
        numbered.append(rows)
    whole = numbered[0]
    for rows in numbered[1:]:
        whole = whole.unionByName(rows)
    u = _draw("mix", F.col("id")) / 4294967296
    kind = F.when(u < limits[0][1], limits[0][0])
    for name, upto in limits[1:]:
        kind = kind.when(u < upto, name)
    size = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(1, n)))]), F.col("kind"))
    attempts = spark.range(tries * wanted).select(F.col("id").alias("attempt"), kind.otherwise(last).alias("kind"), _draw("pick", F.col("id")).alias("p")).withColumn("pick", F.pmod("p", size))
    counted = attempts.join(whole, ["kind", "pick"]).where("ok").select("attempt", "kind", "id")
    first = ahead.select("id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    first = global_index(first, ["id", "copy"], "place").select("place", F.lit("ahead").alias("kind"), "id", F.lit(None).cast("bigint").alias("attempt"))
    n = ahead.count() * copies
    kept = global_index(counted, "attempt", "place").where(F.col("place") < wanted - n)
    return first.unionByName(kept.withColumn("place", F.col("place") + n))


_HASH = lambda name: f"('0x' || substr(md5('{name}:' || i), 1, 8))::BIGINT"
_KINDS = ["benchmark", "tdd", "refactor", "write_verify", "fix_multi", "fix_single"]
_OK = {"tdd": "quality = 1 AND toxic = 0", "refactor": "quality = 1", "write_verify": "quality = 1", "fix_multi": "quality = 1 AND toxic = 1", "fix_single": "toxic = 1"}


@query("mixture_sample", f"""WITH d AS (SELECT doc_id AS id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)),
pool AS (SELECT 'benchmark' AS kind, item_id AS id, true AS ok FROM benchmark {' '.join(f"UNION ALL SELECT '{k}', id, {c} FROM d" for k, c in _OK.items())}),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS pick, count(*) OVER (PARTITION BY kind) AS size FROM pool), s AS (SELECT DISTINCT kind, size FROM p),
a AS (SELECT i AS attempt, CASE {' '.join(f"WHEN {_HASH('mix')}::DOUBLE / 4294967296 < {x} THEN '{k}'" for k, x in MIXTURE)} ELSE 'fix_single' END AS kind, {_HASH('pick')} AS r FROM range((SELECT 6 * count(*) FROM documents)) t(i)),
c AS (SELECT attempt, kind, id, row_number() OVER (ORDER BY attempt) - 1 AS place FROM a JOIN s USING (kind) JOIN p USING (kind) WHERE pick = r % s.size AND ok),
n AS (SELECT count(*) * 8 AS n FROM benchmark)
SELECT row_number() OVER (ORDER BY item_id, k) - 1 AS place, 'ahead' AS kind, item_id AS id, NULL::BIGINT AS attempt FROM benchmark, range(8) t(k)
UNION ALL SELECT place + n, kind, id, attempt FROM c, n WHERE place < (SELECT count(*) FROM documents) - n""")
def mixture_sample(t):
    """As many traces as there are documents: eight of each benchmark passage, then kinds by the fixed shares; whether an
    attempt counts is taken from the documents' labels."""
    d = t.documents.select(F.col("doc_id").alias("id")).join(t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic"), "id", "left").fillna(0, ["quality", "toxic"])
    items = t.benchmark.select(F.col("item_id").alias("id"))
    pools = {"benchmark": items.withColumn("ok", F.lit(True))} | {k: d.select("id", F.expr(c).alias("ok")) for k, c in _OK.items()}
    return mixture(t.spark, pools, MIXTURE, "fix_single", t.documents.count(), items)


def padded_batches(rows: DataFrame, key: str, ids: str | dict[str, Column], labels: str | dict[str, Column], size: int, n: Column | None = None) -> DataFrame:
    """rows with batch, width and pad, and ids and labels filled up to width with 0 and IGNORED.

    Rows are put in order of how many ids they have, then of key, over all partitions, and every size of them are a batch
    that is as wide as its longest: so the rows of a batch are about as long as each other. Null ids are none.

    Only keys and lengths are put in order; rows get their places by a join, as rows of like length side by side would be
    the longest of all in one task. ids and labels may be {name: expression over rows}: these are made after the join, so
    rows travel as short as they are; n then is how many ids a row has.
    """
    made = {k: c for x in (ids, labels) if isinstance(x, dict) for k, c in x.items()}
    ids, labels = [x if isinstance(x, str) else next(iter(x)) for x in (ids, labels)]
    length = F.greatest(F.coalesce(F.size(made.get(ids, F.col(ids))) if n is None else n, F.lit(0)), F.lit(0))
    # Rows of one key and length are told apart by a number, so each gets a place of its own.
    each = F.row_number().over(W.partitionBy("_key", "_n").orderBy(F.lit(0)))
    sized = rows.withColumn("_n", length).withColumn("_key", F.col(key))
    placed = global_index(sized.select("_key", "_n"), ["_n", "_key"], "_place").withColumn("batch", F.floor(F.col("_place") / size))
    wide = placed.withColumn("width", F.max("_n").over(W.partitionBy("batch"))).withColumn("_each", F.row_number().over(W.partitionBy("_key", "_n").orderBy("_place")))
    wide = wide.select(F.col("_key").alias("_k"), F.col("_n").alias("_m"), "_each", "batch", "width")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_n") == F.col("_m")) & (F.col("_same") == F.col("_each"))
    found = sized.withColumn("_same", each).join(wide, same).withColumn("pad", F.col("width") - F.col("_n")).withColumns(made)
    none = F.expr("cast(array() as array<int>)")
    filled = {ids: F.concat(F.coalesce(ids, none), F.array_repeat(F.lit(0), F.col("pad"))), labels: F.concat(F.coalesce(labels, none), F.array_repeat(F.lit(IGNORED), F.col("pad")))}
    return found.withColumns(filled).drop("_n", "_key", "_k", "_m", "_each", "_same")


_PADDED = """WITH r AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS place, list_transform(string_split(text, ''), lambda c: unicode(c) % 256) AS ids FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, n, (place // 32)::BIGINT AS batch, max(n) OVER (PARTITION BY place // 32) AS width, ids FROM r)"""


@query("batch_padding", _PADDED + """ SELECT doc_id, batch, width::INT AS width, (width - n)::INT AS pad, md5(array_to_string(list_concat(ids, list_transform(range(width - n), lambda i: 0)), ' ')) AS ids_md5,
  md5(array_to_string(list_concat(list_transform(ids, lambda x: CASE WHEN x = 32 THEN -100 ELSE x END), list_transform(range(width - n), lambda i: -100)), ' ')) AS labels_md5 FROM b""")
def batch_padding(t):
    """Batches of 32 documents; blanks have no label."""
    ids = char_tokens(F.col("text"), 256)
    rows = t.documents.where("length(text) > 0").select("doc_id", "text")
    labels = F.transform(ids, lambda x: F.when(x == 32, IGNORED).otherwise(x))
    md5 = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " ").cast("binary")).alias(f"{c}_md5")
    return padded_batches(rows, "doc_id", {"ids": ids}, {"labels": labels}, 32, F.length("text")).select("doc_id", "batch", "width", "pad", md5("ids"), md5("labels"))


@query("padding_share", _PADDED + " SELECT sum(width)::BIGINT AS slots, sum(width - n)::BIGINT AS padding, round(sum(width - n) / sum(width), 6) AS share FROM b")
def padding_share(t):
    rows = t.documents.where("length(text) > 0").select("doc_id", F.length("text").alias("n"))
    ids = F.array_repeat(F.lit(0), F.col("n"))
    out = padded_batches(rows, "doc_id", {"ids": ids}, {"labels": ids}, 32, F.col("n"))
    return out.agg(F.sum(F.col("width").cast("bigint")).alias("slots"), F.sum(F.col("pad").cast("bigint")).alias("padding"), F.round(F.sum("pad") / F.sum("width"), 6).alias("share"))


# --- planted rows ---

_P, _R = "left(text, length(text) // 2)", "substr(text, length(text) // 2 + 1)"
_ASCII = lambda x: rf"regexp_replace({x}, '[^\x00-\x7F]', chr(127), 'g')"
_HALVES = f"""WITH h AS (SELECT doc_id, ('0x' || left(md5('mask:' || doc_id), 8))::BIGINT % 5 AS kind, {_ASCII(_P)} AS p, {_ASCII(_R)} AS r FROM documents),
m AS (SELECT doc_id, CASE kind WHEN 0 THEN p WHEN 1 THEN '' WHEN 2 THEN p || r WHEN 3 THEN r || p ELSE left(p, 9) END AS before, CASE kind WHEN 1 THEN p || r WHEN 2 THEN '' ELSE r END AS said FROM h)"""


@query("mask_audit_planted", _HALVES + r""" SELECT doc_id, length(said)::INT AS n_supervised, said = '' AS none, before = '' AND said <> '' AS unmasked, length(said) > 0.8 * length(before || said) AS mostly,
  length(said) > 80 AND contains(before, trim(left(said, 80), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS leak FROM m""")
def mask_audit_planted(t):
    """Every document as a row of one of five kinds: well masked, not masked, nothing supervised, the answer in the prompt as
    well, and a prompt of nine characters."""
    half = F.floor(F.length("text") / 2).cast("int")
    p, r, none = F.left("text", half), F.substr("text", half + 1), F.lit("")
    kind = F.pmod(_draw("mask", F.col("doc_id")), F.lit(5))
    pick = lambda *xs: F.element_at(F.array(*xs), kind.cast("int") + 1)
    before, said = pick(p, none, F.concat(p, r), F.concat(r, p), F.left(p, F.lit(9))), pick(r, F.concat(p, r), none, r, r)
    ids = lambda c: char_tokens(c, 1 << 21)
    rows = t.documents.select("doc_id", ids(before).alias("a"), ids(said).alias("b"))
    masked = rows.select("doc_id", F.concat("a", "b").alias("input_ids"), F.concat(F.transform("a", lambda x: F.lit(IGNORED)), F.col("b")).alias("labels"))
    return mask_audit(masked).select("doc_id", "n_supervised", "none", "unmasked", "mostly", "leak")


@query("prefix_overlap_planted", """WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, left(text, 40) || ' ' || reverse(text) FROM benchmark)
SELECT item_id, doc_id FROM benchmark b JOIN d ON left(b.text, 40) = left(d.text, 40)""")
def prefix_overlap_planted(t):
    """The join on first characters over documents and, for each passage, one that begins as it does and goes on otherwise."""
    first = lambda c: F.left(c, F.lit(40)).alias("p")
    more = t.benchmark.select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.left("text", F.lit(40)), F.lit(" "), F.reverse("text")).alias("text"))
    docs = t.documents.select("doc_id", "text").unionByName(more)
    return t.benchmark.select("item_id", first("text")).join(docs.select("doc_id", first("text")), "p").select("item_id", "doc_id")


_CODE = r'\{"code":\s*"((?:[^"\\]|\\.)*)"\}'
_DIGEST = f"md5(lower(regexp_replace(regexp_extract(call, '{_CODE}', 1), '\\s+', '', 'g')))"
_CODES = f"SELECT conv_id, turn, {_DIGEST} AS code FROM {T.CALLS} AS c WHERE regexp_extract(call, '{_CODE}', 1) <> ''"


def code_digests(calls: DataFrame) -> DataFrame:
    """calls with code: the digest of the code that a call runs, case and white space aside; calls without code go."""
    body = F.regexp_extract("call", _CODE, 1)
    return calls.where(body != "").withColumn("code", F.md5(F.lower(F.regexp_replace(body, r"\s+", "")).cast("binary")))


@query("leak_join", f"""WITH c AS ({_CODES}), pool AS (SELECT code, min(conv_id) AS pool_conv FROM c WHERE conv_id % 2 = 0 GROUP BY code)
SELECT conv_id, count(*) AS leaks, count(DISTINCT code) AS codes, min(pool_conv) AS pool_conv FROM c JOIN pool USING (code) WHERE conv_id % 2 = 1 GROUP BY conv_id""")
def leak_join(t):
    """The responses of odd conversations that run code which the pool, of the even ones, holds: by an equi-join on digests,
    the pool a row for each code."""
    calls = code_digests(T.rows_of(t, T.CALLS).select("conv_id", "call"))
    pool = calls.where("conv_id % 2 = 0").groupBy("code").agg(F.min("conv_id").alias("pool_conv"))
    met = calls.where("conv_id % 2 = 1").join(pool, "code")
    return met.groupBy("conv_id").agg(F.count("*").alias("leaks"), F.countDistinct("code").alias("codes"), F.min("pool_conv").alias("pool_conv"))
