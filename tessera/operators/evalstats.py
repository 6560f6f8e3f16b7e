"""Evaluation analytics: rates, breakdowns, comparisons of runs, routing policies, verdicts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent, truthy
from ..plans.registry import query
from .sequence import global_index


def pass_rate(df: DataFrame, passed: Column, *keys: str) -> DataFrame:
    p, n = F.count_if(passed), F.count("*")
    return df.groupBy(*keys).agg(p.alias("p"), n.alias("n"), percent(p, n).alias("rate"))


def quadrant(a: Column, b: Column) -> Column:
    return F.when(a & b, "both").when(a, "first_only").when(b, "second_only").otherwise("neither")


def compare_runs(a: DataFrame, b: DataFrame, key: str, passed: str) -> DataFrame:
    """(key, a_passed, b_passed, quadrant) of every id in either run; a missing side has not passed."""
    left, right = a.select(key, F.col(passed).alias("a_passed")), b.select(key, F.col(passed).alias("b_passed"))
    both = left.join(right, key, "full").select(key, F.coalesce("a_passed", F.lit(False)).alias("a_passed"), F.coalesce("b_passed", F.lit(False)).alias("b_passed"))
    return both.withColumn("quadrant", quadrant(F.col("a_passed"), F.col("b_passed")))


#: Tasks that must pass for a promotion, and that the champion passed.
PROMOTION, CHAMPION = 24, 23


def verdict(p: Column, n: Column, threshold: int = PROMOTION, champion: int = CHAMPION) -> Column:
    """By counts of passed tasks: PROMOTE, tie with the champion, or reject; a dash without tasks."""
    return F.when(n == 0, "—").when(p >= threshold, "PROMOTE").when(p == champion, "tie").otherwise("reject")


def _judged(t) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id").withColumn("a", F.col("quality") == 1).withColumn("b", F.col("toxic") == 0)


_J = "WITH j AS (SELECT doc_id, lang, source, quality = 1 AS a, toxic = 0 AS b FROM documents JOIN labels USING (doc_id))"
_RATE = "coalesce(round_even(100.0 * count(*) FILTER (a)::DOUBLE / nullif(count(*), 0), 1), 0)"


@query("pass_rate", f"{_J} SELECT count(*) FILTER (a) AS p, count(*) AS n, {_RATE} AS rate FROM j")
def pass_rate_query(t):
    return pass_rate(_judged(t), F.col("a"))


@query("by_category", f"{_J} SELECT lang, count(*) FILTER (a) AS p, count(*) AS n, {_RATE} AS rate FROM j GROUP BY lang")
def by_category(t):
    return pass_rate(_judged(t), F.col("a"), "lang")


@query("by_category_floor", f"{_J} SELECT lang, 100 * count(*) FILTER (a) // count(*) AS pct FROM j GROUP BY lang")
def by_category_floor(t):
    return _judged(t).groupBy("lang").agg(F.expr("100 * count_if(a) div count(*)").alias("pct"))


@query("family_breakdown", f"{_J} SELECT source, count(*) FILTER (a) AS p, count(*) AS n, string_agg(doc_id || ':' || CASE WHEN a THEN 'PASS' ELSE 'FAIL' END, ' ' ORDER BY doc_id) AS tasks FROM j GROUP BY source")
def family_breakdown(t):
    item = F.struct("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("a"), "PASS").otherwise("FAIL")).alias("s"))
    tasks = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " ")
    return _judged(t).groupBy("source").agg(F.count_if("a").alias("p"), F.count("*").alias("n"), tasks.alias("tasks"))


@query("family_items", f"{_J} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id, CASE WHEN a THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j")
def family_items(t):
    """The tasks of each family as rows, numbered, whatever its size."""
    from .sequence import numbered

    rows = _judged(t).select("source", "doc_id", F.when(F.col("a"), "PASS").otherwise("FAIL").alias("verdict"))
    return numbered(rows, "source", ["doc_id"], "place").select("source", "place", "doc_id", "verdict")


@query("family_rollup", f"{_J} SELECT coalesce(source, 'TOTAL') AS source, count(*) FILTER (a) AS p, count(*) AS n FROM j GROUP BY ROLLUP (source)")
def family_rollup(t):
    r = _judged(t).rollup("source").agg(F.count_if("a").alias("p"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    return r.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "p", "n")


@query("ab_failure_diff", f"{_J}, x AS (SELECT doc_id, a FROM j WHERE doc_id % 2 = 0), y AS (SELECT doc_id, b FROM j WHERE doc_id % 3 = 0), f AS (SELECT doc_id, coalesce(a, false) AS a_passed, coalesce(b, false) AS b_passed FROM x FULL JOIN y USING (doc_id)) SELECT *, CASE WHEN a_passed AND b_passed THEN 'both' WHEN a_passed THEN 'first_only' WHEN b_passed THEN 'second_only' ELSE 'neither' END AS quadrant FROM f")
def ab_failure_diff(t):
    j = _judged(t)
    return compare_runs(j.where("doc_id % 2 = 0").select("doc_id", F.col("a").alias("passed")), j.where("doc_id % 3 = 0").select("doc_id", F.col("b").alias("passed")), "doc_id", "passed")


@query("quadrants", f"{_J} SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'neither' END AS quadrant, count(*) AS n FROM j GROUP BY 1")
def quadrants(t):
    return _judged(t).groupBy(quadrant(F.col("a"), F.col("b")).alias("quadrant")).agg(F.count("*").alias("n"))


@query("oracle_route", f"{_J} SELECT d.doc_id, CASE WHEN a IS NULL THEN 'unknown' WHEN b AND NOT a THEN 'repair' ELSE 'champion' END AS route FROM documents d LEFT JOIN j USING (doc_id)")
def oracle_route(t):
    route = F.when(F.col("a").isNull(), "unknown").when(F.col("b") & ~F.col("a"), "repair").otherwise("champion")
    return t.documents.select("doc_id").join(_judged(t).select("doc_id", "a", "b"), "doc_id", "left").select("doc_id", route.alias("route"))


@query("route_split", "SELECT CASE lang WHEN 'en' THEN 'champion' ELSE 'repair' END AS route, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM documents GROUP BY 1")
def route_split(t):
    route = F.when(F.col("lang") == "en", "champion").otherwise("repair")
    return t.documents.groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


@query("merge_override", "SELECT doc_id, max_by(tag, pri) AS tag FROM (SELECT doc_id, 'first' AS tag, 1 AS pri FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'second', 2 FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def merge_override(t):
    part = lambda tag, pri, keep: t.documents.where(keep).select("doc_id", F.lit(tag).alias("tag"), F.lit(pri).alias("pri"))
    return part("first", 1, "doc_id % 2 = 0").unionByName(part("second", 2, "doc_id % 3 = 0")).groupBy("doc_id").agg(F.max_by("tag", "pri").alias("tag"))


def routing_table(scores: DataFrame, key: str, routers: dict[str, DataFrame]) -> DataFrame:
    """scores with a column <name>_pass for each router's results (key, passed), empty where it has none."""
    out = scores
    for name, results in routers.items():
        mine = results.select(F.col(key).alias("_key"), F.col("passed").cast("string").alias(f"{name}_pass"))
        out = out.join(mine, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(f"{name}_pass", F.coalesce(f"{name}_pass", F.lit("")))
    return out


@query("per_task_routing", "SELECT d.doc_id, d.source AS family, coalesce(a.p, '') AS family_router_pass, coalesce(b.p, '') AS conf_router_pass, coalesce(c.p, '') AS oracle_router_pass FROM documents d LEFT JOIN (SELECT doc_id, (quality = 1)::VARCHAR AS p FROM labels) a USING (doc_id) LEFT JOIN (SELECT doc_id, (toxic = 0)::VARCHAR AS p FROM labels WHERE doc_id % 2 = 0) b USING (doc_id) LEFT JOIN (SELECT doc_id, (quality = 1 OR toxic = 0)::VARCHAR AS p FROM labels WHERE doc_id % 3 = 0) c USING (doc_id)")
def per_task_routing(t):
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    run = lambda passed, n: t.labels.where(f"doc_id % {n} = 0").select("doc_id", passed.alias("passed"))
    return routing_table(t.documents.select("doc_id", F.col("source").alias("family")), "doc_id", {"family_router": run(a, 1), "conf_router": run(b, 2), "oracle_router": run(a | b, 3)})


#: Scores from which the second index is asked, and the family that always asks it.
LEAST_SCORE, LEAST_MARGIN, REPAIR_FAMILY = 0.35, 0.05, "interval_merge"


def family_route(family: Column) -> Column:
    return F.when(family == REPAIR_FAMILY, "repair").otherwise("champion")


def confidence_route(champion: Column, repair: Column) -> Column:
    """By the best score in either index; a missing score is 0."""
    c, r = F.coalesce(champion, F.lit(0.0)), F.coalesce(repair, F.lit(0.0))
    return F.when((F.round(r, 9) >= LEAST_SCORE) & (F.round(r - c, 9) >= LEAST_MARGIN), "repair").otherwise("champion")


@query("routes", "WITH s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') / 100 AS c, avg(value) FILTER (event_type = 'purchase') / 100 AS r FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'repair' ELSE 'champion' END AS by_family, CASE WHEN round(coalesce(r, 0), 9) >= 0.35 AND round(coalesce(r, 0) - coalesce(c, 0), 9) >= 0.05 THEN 'repair' ELSE 'champion' END AS route FROM s")
def routes(t):
    """The family rule and the confidence rule on two scores."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value"))) / 100
    s = t.events.groupBy("user_id").agg(mean("click").alias("c"), mean("purchase").alias("r"))
    family = F.when(F.col("user_id") % 10 == 0, REPAIR_FAMILY).otherwise("other")
    return s.select("user_id", family_route(family).alias("by_family"), confidence_route(F.col("c"), F.col("r")).alias("route"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


def run_pivot(rows: DataFrame, key: str, run: str, failed: Column, order: list, runs: list[str]) -> DataFrame:
    """(key, place, a column a run): PASS or FAIL by the first row of each key and run, a dash where there is none;
    place: keys by their first appearance, from 0."""
    first = rows.groupBy(key, run).agg(F.min_by(F.when(failed, "FAIL").otherwise("PASS"), F.struct(*order)).alias("s"), F.min(F.struct(*order)).alias("o"))
    wide = first.groupBy(key).agg(F.min("o").alias("o"), *[F.coalesce(F.max(F.when(F.col(run) == r, F.col("s"))), F.lit("—")).alias(r) for r in runs])
    return global_index(wide, ["o"], "place").drop("o")


@query("per_task_pivot", "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) SELECT user_id, row_number() OVER (ORDER BY min((ts, event_id))) - 1 AS place, " + ", ".join(f"coalesce(max(CASE WHEN value > 150 THEN 'FAIL' ELSE 'PASS' END) FILTER (r = 1 AND event_type = '{k}'), '—') AS {k}" for k in _KINDS) + " FROM f GROUP BY 1")
def per_task_pivot(t):
    return run_pivot(t.events, "user_id", "event_type", F.col("value") > 150, ["ts", "event_id"], _KINDS)


@query("failure_hist", "SELECT event_type AS reason, count(*) AS n FROM events WHERE event_type <> '' AND value > 100 GROUP BY 1")
def failure_hist(t):
    return t.events.where("event_type <> '' and value > 100").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


@query("failure_matrix", "SELECT event_type AS reason, count(*) FILTER (user_id % 3 = 0) AS run0, count(*) FILTER (user_id % 3 = 1) AS run1, count(*) FILTER (user_id % 3 = 2) AS run2 FROM events GROUP BY 1")
def failure_matrix(t):
    run = F.concat(F.lit("run"), F.pmod("user_id", F.lit(3)).cast("string"))
    return t.events.select(F.col("event_type").alias("reason"), run.alias("run")).groupBy("reason").pivot("run", ["run0", "run1", "run2"]).count().fillna(0)


@query("critique_lift", f"{_J} SELECT round(count(*) FILTER (a AND b) / greatest(count(*) FILTER (b), 1) - count(*) FILTER (a AND NOT b) / greatest(count(*) FILTER (NOT b), 1), 6) AS lift FROM j")
def critique_lift(t):
    rate = lambda cond: F.count_if(F.col("a") & cond) / F.greatest(F.count_if(cond), F.lit(1))
    return _judged(t).agg(F.round(rate(F.col("b")) - rate(~F.col("b")), 6).alias("lift"))


@query("corrected_audit", f"{_J} SELECT count(*) FILTER (a) AS raw_p, count(*) AS raw_n, count(*) FILTER (a AND doc_id NOT IN (SELECT item_id FROM benchmark)) AS p, count(*) FILTER (doc_id NOT IN (SELECT item_id FROM benchmark)) AS n FROM j")
def corrected_audit(t):
    """Counts over all tasks, and without those on the list of conflicting ones (here: ids of benchmark)."""
    listed = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(True).alias("out")).distinct()
    rows, fine = _judged(t).join(listed, "doc_id", "left"), F.col("out").isNull()
    return rows.agg(F.count_if("a").alias("raw_p"), F.count("*").alias("raw_n"), F.count_if(F.col("a") & fine).alias("p"), F.count_if(fine).alias("n"))


@query("promotion_verdict", f"{_J}, s AS (SELECT source, count(*) FILTER (a) AS p, count(*) AS n FROM j GROUP BY 1) SELECT source, CASE WHEN n = 0 THEN '—' WHEN p >= 16 THEN 'PROMOTE' WHEN p = 15 THEN 'tie' ELSE 'reject' END AS verdict FROM s")
def promotion_verdict(t):
    s = _judged(t).groupBy("source").agg(F.count_if("a").alias("p"), F.count("*").alias("n"))
    return s.select("source", verdict(F.col("p"), F.col("n"), 16, 15).alias("verdict"))


#: Percentages, and points of difference, by which runs are judged.
LEAST_RATE, MERGE_DROP, MEMORY_LIFT, ENV_DELTA = 75.0, 5.0, 10.0, 3.0


def findings(champion: Column, merged: Column, no_memory: Column, env_a: Column, env_b: Column) -> Column:
    """What the pass rates of five runs say, in order; a rate that is null says nothing."""
    either = lambda c, yes, no: F.when(c, yes).when(~c, no)
    return F.array_compact(F.array(
        either(champion >= LEAST_RATE, "champion confirmed", "champion dropped"),
        either(F.abs(merged - champion) <= MERGE_DROP, "merge safe", "merge damaged"),
        either(champion - no_memory >= MEMORY_LIFT, "memory dependent", "not memory driven"),
        either(F.abs(env_a - env_b) > ENV_DELTA, "environment sensitive", "environment stable"),
    ))


_RUN_RATES = [f"coalesce(round_even(100.0 * count(*) FILTER (a AND doc_id % 5 = {i})::DOUBLE / nullif(count(*) FILTER (doc_id % 5 = {i}), 0), 1), 0) AS r{i}" for i in range(5)]


@query("diagnose", f"{_J}, r AS (SELECT source, {', '.join(_RUN_RATES)} FROM j GROUP BY 1) SELECT source, CASE WHEN r0 >= 75 THEN 'champion confirmed' ELSE 'champion dropped' END || '; ' || CASE WHEN abs(r1 - r0) <= 5 THEN 'merge safe' ELSE 'merge damaged' END || '; ' || CASE WHEN r0 - r2 >= 10 THEN 'memory dependent' ELSE 'not memory driven' END || '; ' || CASE WHEN abs(r3 - r4) > 3 THEN 'environment sensitive' ELSE 'environment stable' END AS diagnosis FROM r")
def diagnose(t):
    """The findings for each source, whose documents make five runs by id."""
    rate = lambda i: percent(F.count_if(F.col("a") & (F.col("doc_id") % 5 == i)), F.count_if(F.col("doc_id") % 5 == i))
    r = _judged(t).groupBy("source").agg(*[rate(i).alias(f"r{i}") for i in range(5)])
    return r.select("source", F.array_join(findings(*[F.col(f"r{i}") for i in range(5)]), "; ").alias("diagnosis"))


@query("metric_delta", f"{_J}, x AS (SELECT lang, avg(a::INT) AS v FROM j WHERE doc_id % 2 = 0 GROUP BY 1), y AS (SELECT lang, avg(a::INT) AS v FROM j WHERE doc_id % 2 = 1 GROUP BY 1) SELECT lang, round(y.v - x.v, 6) AS delta FROM x JOIN y USING (lang)")
def metric_delta(t):
    side = lambda r, n: _judged(t).where(f"doc_id % 2 = {r}").groupBy("lang").agg(F.avg(F.col("a").cast("int")).alias(n))
    return side(0, "x").join(side(1, "y"), "lang").select("lang", F.round(F.col("y") - F.col("x"), 6).alias("delta"))


@query("keyword_score", "SELECT lang, round(avg((contains(lower(text), 'the') OR contains(lower(text), ' de '))::INT), 6) AS score FROM documents GROUP BY 1")
def keyword_score(t):
    low = F.lower("text")
    hit = F.exists(F.array(F.lit("the"), F.lit(" de ")), lambda k: F.contains(low, k))
    return t.documents.groupBy("lang").agg(F.round(F.avg(hit.cast("int")), 6).alias("score"))


@query("passed_variants", "SELECT conv_id, turn, lower(trim(f)) IN ('true', '1', 'yes') AS loose, lower(trim(f)) IN ('true', '1', 'yes', 'pass') AS looser, f = 'True' AS exact FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN 'PASS' ELSE '' END AS f FROM conversations)")
def passed_variants(t):
    f = F.when(F.col("turn") % 4 == 0, "True").when(F.col("turn") % 4 == 1, " yes ").when(F.col("turn") % 4 == 2, "PASS").otherwise("")
    return t.conversations.select("conv_id", "turn", truthy(f).alias("loose"), truthy(f, ("true", "1", "yes", "pass")).alias("looser"), (f == "True").alias("exact"))


@query("pct_round", "SELECT event_id, round_even(value, 1) AS r FROM events")
def pct_round(t):
    return t.events.select("event_id", F.bround("value", 1).alias("r"))


@query("value_counts_top", "SELECT source, n FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1) ORDER BY n DESC, first LIMIT 10")
def value_counts_top(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first").limit(10).select("source", "n")


@query("dup_ids", "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_ids(t):
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n")).where("n > 1")


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """(place, line): a Markdown table of a small df: its header, the rule below it, then a line for each row in order."""
    cell = lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(df.columns) + " |"), (-1, "|" + "---|" * len(df.columns))], "place bigint, line string")
    body = global_index(df.select(*order, *[F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(f"_{c}") for c in df.columns]), order, "place")
    return head.unionByName(body.select("place", cell([F.col(f"_{c}") for c in df.columns]).alias("line")))


@query("md_row", f"{_J} SELECT -2 AS place, '| lang | passed |' AS line UNION ALL SELECT -1, '|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY lang) - 1, '| ' || lang || ' | ' || count(*) FILTER (a) || '/' || count(*) || ' |' FROM j GROUP BY lang")
def md_row(t):
    passed = F.concat(F.count_if("a").cast("string"), F.lit("/"), F.count("*").cast("string"))
    return markdown(_judged(t).groupBy("lang").agg(passed.alias("passed")), ["lang"])