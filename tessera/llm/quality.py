"""Quality rules with thresholds that adapt to each language and source; built-in functions only.

Each metric is an integer, sketched per (language, source) as counts over the lattice of integers with four
significant bits (a high-dynamic-range histogram). Sketches merge by adding counts and have at most 8 cells per
octave, so a threshold costs the same memory for ten rows or ten billion. Every (language, source) has thresholds of
its own sketch, to which its language's sketch is added with the weight of PRIOR_DOCS documents: a group of many
documents has its own thresholds, one of few hardly differs from its language.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, stored, table

WORD_GAP = r"[\x20\x09-\x0D]+"
#: metric, slack above the upper fence (below the lower one for metrics that have it), lower fence too.
METRICS = (("symbol_rate", 50, False), ("dup_line_rate", 300, False), ("word_length", 20, True))
#: Documents that a language's sketch counts for in each of its sources'.
PRIOR_DOCS = 100
SPREADS = 3


def cell(v: Column) -> Column:
    """v cut to its four leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 4, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in words, the first occurrence included."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        last = F.size(windows) - 1

        def starts(s: Column) -> Column:
            def twin(e: Column, k: Column) -> Column:
                return ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == e["h"]))

            return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["p"]))

        total = F.aggregate(
            let(ordered, starts),
            F.struct(F.lit(-5).alias("at"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(5), p - acc["at"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(total)

    def windows_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(5)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 6, F.lit(0).cast("bigint")).otherwise(let(let(hashed, windows_of), covered))


def base_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col("lang").alias("lang"), F.col("source").alias("source"), text.alias("text"))
    rows = rows.select("doc_id", "lang", "source", "text", F.filter(F.split("text", WORD_GAP), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", WORD_GAP, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words")


def with_rates(base: DataFrame) -> DataFrame:
    rate = lambda a, k, b: (F.col(a) * k).cast("bigint") / F.greatest(F.col(b), F.lit(1))
    whole = lambda c: F.floor(c).cast("bigint")
    return base.withColumns({
        "symbol_rate": whole(rate("n_symbols", 1000, "word_chars")),
        "dup_line_rate": whole(rate("n_dup_lines", 1000, "n_lines")),
        "word_length": whole(rate("word_chars", 10, "n_words")),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })


def fences(rated: DataFrame) -> DataFrame:
    """One row per (lang, source) with <metric>_low and <metric>_high. Rows that fail the base rules don't count."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), cell(F.col(m)).alias("at")) for m, _, _ in METRICS]))
    sketch = stored(rated.where(~F.col("base_failed")).select("lang", "source", cells.alias("c")).groupBy("lang", "source", "c.metric", "c.at").agg(F.count("*").alias("n")), "sketch")

    of_lang = sketch.groupBy("lang", "metric", "at").agg(F.sum("n").alias("lang_n"))
    of_lang = of_lang.withColumn("lang_all", F.sum("lang_n").over(W.partitionBy("lang", "metric")))
    groups = rated.select("lang", "source").distinct()
    same = lambda a, b, *keys: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" for k in keys))
    cells = groups.alias("g").join(of_lang.alias("l"), same("g", "l", "lang")).select("g.lang", "g.source", "l.metric", "l.at", "l.lang_n", "l.lang_all")
    cells = cells.alias("c").join(sketch.alias("s"), same("c", "s", "lang", "source", "metric", "at"), "left")
    # Whole numbers: own count x the language's documents + PRIOR_DOCS x the language's count.
    big = lambda c: F.col(c).cast("decimal(18,0)")
    weight = F.coalesce(big("s.n"), F.lit(0).cast("decimal(18,0)")) * big("c.lang_all") + F.lit(PRIOR_DOCS).cast("decimal(18,0)") * big("c.lang_n")
    weighed = cells.select("c.lang", "c.source", "c.metric", "c.at", weight.alias("w"))
    group = W.partitionBy("lang", "source", "metric")
    ranked = weighed.withColumn("upto", F.sum("w").over(group.orderBy("at"))).withColumn("all", F.sum("w").over(group))
    q = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("at")))
    found = ranked.groupBy("lang", "source", "metric").agg(q(5).alias("q05"), q(50).alias("q50"), q(95).alias("q95"))
    bounds = []
    for m, slack, low in METRICS:
        mine = lambda c: F.max(F.when(F.col("metric") == m, c))  # noqa: B023, E731
        bounds += [
            mine(F.col("q95") + SPREADS * (F.col("q95") - F.col("q50")) + slack).alias(f"{m}_high"),
            (mine(F.col("q05") - SPREADS * (F.col("q50") - F.col("q05")) - slack) if low else F.lit(None).cast("bigint")).alias(f"{m}_low"),
        ]
    return found.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*bounds)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the base counts, base_failed, kept, and the metrics that the verdict compares.

    A document is kept if it passes the base rules and no metric lies beyond its group's fences: upper fence
    q95 + 3 (q95 - q50) + slack, lower fence q05 - 3 (q50 - q05) - slack, from the sketch of its language and source
    with that of its language as a prior.
    A null text has no words and fails the base rules. Null languages and sources are groups of their own. Repeated
    rows each get a row; other columns are ignored; an empty df gives no rows.
    """
    rated = with_rates(stored(base_metrics(df, id_col, text_col), "metrics"))
    judged = rated.join(fences(rated), F.expr("lang <=> f_lang AND source <=> f_source"), "left")
    inside = [F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True)) & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True)) for m, _, _ in METRICS]
    verdict = ~F.col("base_failed") & reduce(lambda a, b: a & b, inside)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))


def op9_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


_PICKS = ", ".join(
    f"max(q95 + {SPREADS} * (q95 - q50) + {slack}) FILTER (metric = '{m}') AS {m}_high, " + (f"max(q05 - {SPREADS} * (q50 - q05) - {slack}) FILTER (metric = '{m}')" if low else "NULL::BIGINT") + f" AS {m}_low"
    for m, slack, low in METRICS
)
_CELL = "(({m} >> greatest(length(bin({m})) - 4, 0)) << greatest(length(bin({m})) - 4, 0))"
_CELLS = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_CELL.format(m=m)} AS edge FROM rated WHERE NOT base_failed" for m, _, _ in METRICS)
_INSIDE = " AND ".join(f"coalesce(r.{m} <= f.{m}_high, true) AND coalesce(r.{m} >= f.{m}_low, true)" for m, _, _ in METRICS)

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 5], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(len(words) - 4)) AS i FROM d WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
rated AS (SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate,
  n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate, word_chars * 10 // greatest(n_words, 1) AS word_length,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
sketch AS (SELECT lang, source, metric, edge, count(*) AS n FROM ({_CELLS}) GROUP BY ALL),
of_lang AS (SELECT lang, metric, edge, sum(n) AS ln, sum(sum(n)) OVER (PARTITION BY lang, metric) AS lt FROM sketch GROUP BY lang, metric, edge),
weighed AS (SELECT g.lang, g.source, l.metric, l.edge, coalesce(s.n, 0)::HUGEINT * l.lt + {PRIOR_DOCS} * l.ln AS w
  FROM (SELECT DISTINCT lang, source FROM rated) g JOIN of_lang l ON g.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN sketch s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.metric = l.metric AND s.edge = l.edge),
cum AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY edge) AS upto, sum(w) OVER (PARTITION BY lang, source, metric) AS total FROM weighed),
q AS (SELECT lang, source, metric, min(edge) FILTER (100 * upto >= 5 * total) AS q05, min(edge) FILTER (100 * upto >= 50 * total) AS q50,
  min(edge) FILTER (100 * upto >= 95 * total) AS q95 FROM cum GROUP BY lang, source, metric),
f AS (SELECT lang, source, {_PICKS} FROM q GROUP BY lang, source)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
  NOT r.base_failed AND {_INSIDE} AS kept
FROM rated r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
