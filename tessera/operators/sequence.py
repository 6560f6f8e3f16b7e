"""Ordered operators: moving statistics, buckets, samples, state machines, packing, monitoring of training logs."""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import char_tokens, duration, equal_width_bin
from ..plans.registry import query
from ..plans.storage import stored


#: Bits of a partition-wise row number that number the rows of a partition.
_BITS = 33


def in_order(df: DataFrame, order: list) -> DataFrame:
    """df in the order of its columns `order`, with _m: a number for each row whose upper bits are its partition's. To be
    stored, as a second evaluation may cut the ranges elsewhere: bounds are sampled, and small partitions merged."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())


def _dealt(df: DataFrame, order: list, name: str) -> DataFrame:
    return stored(in_order(df, order), name)


def global_index(df: DataFrame, key: str | list, name: str) -> DataFrame:
    """df with name = the row's place, from 0, in the order of key, without one task that sees all rows.

    Rows are range-partitioned, sorted and stored once; each partition numbers its own and adds the sizes of those
    before it. Rows with equal keys are placed one after another in any order.
    """
    return placed(_dealt(df, [key] if isinstance(key, str) else key, name), name)


def placed(dealt: DataFrame, name: str) -> DataFrame:
    """The stored rows of in_order with name = the row's place, from 0, instead of _m."""
    part = F.expr(f"shiftright(_m, {_BITS})")
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND((1 << _BITS) - 1)
    return dealt.join(F.broadcast(before), part == F.col("_q")).withColumn(name, place.cast("bigint")).drop("_m", "_q", "_before")


def numbered(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """df with name = the row's place, from 1, in the order of its group, however large a group is.

    As global_index, but with the sizes of each group in each partition: a row for each partition and group.
    """
    dealt = _dealt(df, [group, *order], name).withColumn("_p", F.expr(f"shiftright(_m, {_BITS})"))
    sizes = dealt.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("_g").orderBy("_q")) - F.col("_n") - F.col("_first"))
    joined = dealt.join(before.select("_g", "_q", "_before"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn(name, (F.col("_m") + F.col("_before") + 1).cast("bigint")).drop("_m", "_p", "_g", "_q", "_before")


#: Steps that one task of a moving window sees, besides its neighbours'.
BLOCK = 1 << 16


def blocks(steps: DataFrame, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """steps with _block, and copies of the `before` rows ahead of each block and the `after` rows behind it (_own is
    false), so that a moving window needs its block alone: one run may be any length."""
    home = F.floor((F.col("step") - 1) / size)
    reach = F.sequence(F.floor((F.col("step") - 1 - after) / size), F.floor((F.col("step") - 1 + before) / size))
    return steps.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == home)


def moving(steps: DataFrame, run: str, what: dict, before: int, after: int = 0) -> DataFrame:
    """The run's own rows of steps with the columns of what: name -> f(window over the block in step order)."""
    w = W.partitionBy(run, "_block").orderBy("step")
    spread = blocks(steps, before, after)
    return spread.withColumns({k: f(w) for k, f in what.items()}).where("_own").drop("_block", "_own")


def rolling(steps: DataFrame, run: str, value: str, width: int, name: str, how=F.avg) -> DataFrame:
    """steps with name = how over the last width values of the run, fewer at its start."""
    return moving(steps, run, {name: lambda w: how(value).over(w.rowsBetween(1 - width, 0))}, width - 1)


def fit_weights(m: int) -> list[list[float]]:
    """Row i holds the weights that m values have in the quadratic least-squares fit at the i-th of them."""
    x = np.arange(m) - (m - 1) / 2
    basis = np.stack([np.ones(m), x, x * x], axis=1)
    return (basis @ np.linalg.pinv(basis)).tolist()


def savgol(steps: DataFrame, run: str, value: str, name: str, most: int = 11) -> DataFrame:
    """Quadratic Savitzky-Golay smoothing with a window of most values, or the largest odd number that the run has.

    At the edges the first (last) window's fit is evaluated. Runs of four values or fewer get a moving mean of three.
    """
    sizes = steps.groupBy(F.col(run).alias("_r")).agg(F.count("*").alias("_n"))  # a row for each run
    m = F.least(F.lit(most), F.col("_n") - (F.col("_n") + 1) % 2).cast("int")
    rows = steps.join(F.broadcast(sizes), F.col(run) == F.col("_r")).withColumn("_w", m)
    half = (F.col("_w") - 1) / 2
    # The window that a step's fit lies in begins here.
    begin = F.least(F.greatest(F.col("step") - half, F.lit(1)), F.col("_n") - F.col("_w") + 1).cast("bigint")
    rows = rows.withColumn("_at", (F.col("step") - begin).cast("int"))
    width = most - 1
    seen = lambda w: F.collect_list(F.struct("step", F.col(value).alias("v"))).over(w.rowsBetween(-width, width))
    near = moving(rows, run, {"_near": seen}, width, width)
    inside = F.transform(F.filter("_near", lambda x: (x["step"] >= F.col("step") - F.col("_at")) & (x["step"] < F.col("step") - F.col("_at") + F.col("_w"))), lambda x: x["v"])
    table = F.create_map(*[y for k in range(5, most + 1, 2) for y in (F.lit(k), F.array(*[F.array(*map(F.lit, r)) for r in fit_weights(k)]))])
    weights = F.get(F.try_element_at(table, F.col("_w")), F.col("_at"))
    fitted = F.aggregate(F.zip_with(inside, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    plain = F.filter("_near", lambda x: F.abs(x["step"] - F.col("step")) <= 1)
    mean = F.aggregate(plain, F.lit(0.0), lambda a, x: a + x["v"]) / F.size(plain)
    return near.withColumn(name, F.when(F.col("_n") > 4, fitted).otherwise(mean)).drop("_r", "_n", "_w", "_at", "_near")


def _steps(t) -> DataFrame:
    """The events as a training log: a run for each event type, a step for each event in time order."""
    return numbered(t.events.select("event_type", "event_id", "ts", "user_id", "value"), "event_type", ["ts", "event_id"], "step")


_STEPS = "WITH s AS (SELECT event_type, event_id, ts, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)"


@query("rolling_mean", _STEPS + " SELECT event_type, step, round(avg(value) OVER (PARTITION BY event_type ORDER BY step ROWS 9 PRECEDING), 6) AS mean10 FROM s")
def rolling_mean(t):
    return rolling(_steps(t), "event_type", "value", 10, "m").select("event_type", "step", F.round("m", 6).alias("mean10"))


@query("rolling_std", _STEPS + " SELECT event_type, step, round(coalesce(stddev_samp(value) OVER (PARTITION BY event_type ORDER BY step ROWS 9 PRECEDING), 0), 4) AS std10 FROM s")
def rolling_std(t):
    return rolling(_steps(t), "event_type", "value", 10, "d", F.stddev_samp).select("event_type", "step", F.round(F.coalesce("d", F.lit(0.0)), 4).alias("std10"))


_FIT = fit_weights(11)
_SG = "CASE WHEN step <= 5 THEN list_sum(list_transform(range(1, 12), lambda k: head[k] * w[step::INT][k])) WHEN step > n - 5 THEN list_sum(list_transform(range(1, 12), lambda k: tail[k] * w[(step - n + 11)::INT][k])) ELSE list_sum(list_transform(range(1, 12), lambda k: near[k] * w[6][k])) END"


@query("savgol", _STEPS + f", e AS (SELECT event_type, count(*) AS n, list(value ORDER BY step) FILTER (step <= 11) AS head, list(value ORDER BY step DESC) AS back FROM s GROUP BY 1), f AS (SELECT event_type, n, head, list_reverse(back[1:11]) AS tail, {_FIT} AS w FROM e), x AS (SELECT event_type, step, list(value) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM s) SELECT event_type, step, round({_SG}, 6) + 0.0 AS smooth FROM x JOIN f USING (event_type)")
def savgol_query(t):
    return savgol(_steps(t), "event_type", "value", "smooth").select("event_type", "step", (F.round("smooth", 6) + 0.0).alias("smooth"))


@query("savgol_interior", _STEPS + " SELECT event_type, step, round((-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35, 6) + 0.0 AS smooth FROM s WINDOW w AS (PARTITION BY event_type ORDER BY step)")
def savgol_interior(t):
    """The window of five only, null at the edges."""
    fit = fit_weights(5)[2]
    total = lambda w: fit[2] * F.col("value") + sum(fit[2 + i] * F.lead("value", i).over(w) + fit[2 - i] * F.lag("value", i).over(w) for i in (1, 2))
    return moving(_steps(t), "event_type", {"smooth": total}, 2, 2).select("event_type", "step", (F.round("smooth", 6) + 0.0).alias("smooth"))


_RUNS = _STEPS + " SELECT event_type AS run, step, round(avg(value) OVER (PARTITION BY event_type ORDER BY step ROWS 4 PRECEDING), 6) AS loss FROM s"


@query("multi_run", _RUNS)
@query("multi_run_all", _RUNS)
def multi_run(t):
    return rolling(_steps(t), "event_type", "value", 5, "m").select(F.col("event_type").alias("run"), "step", F.round("m", 6).alias("loss"))


def log_lines(steps: DataFrame, run: str, loss: str, tokens: str, time: str, every: int) -> DataFrame:
    """(run, bucket, n, mean_loss, tok_per_sec, eta) of every `every` steps: tokens over the time since the bucket before
    (or since the run's first step), and how long the steps that are left take at that rate."""
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    total = steps.groupBy(F.col(run).alias("_r")).agg(F.max("step").alias("_steps"), F.min(seconds(time)).alias("_begin"))
    rows = steps.groupBy(run, F.floor((F.col("step") - 1) / every).cast("int").alias("bucket")).agg(F.round(F.avg(loss), 6).alias("mean_loss"), F.count("*").alias("n"), F.sum(tokens).alias("_tokens"), F.max(seconds(time)).alias("_now"), F.max("step").alias("_at"))
    rows = rows.join(F.broadcast(total), F.col(run) == F.col("_r"))  # a row a run
    spent = F.col("_now") - F.coalesce(F.lag("_now").over(W.partitionBy(run).orderBy("bucket")), F.col("_begin"))
    rows = rows.withColumn("_spent", spent)
    left = ((F.col("_steps") - F.col("_at")) * F.col("_spent") / every).cast("bigint")
    rate = F.round(F.col("_tokens") / F.greatest(F.col("_spent"), F.lit(1e-6)), 1)
    return rows.select(run, "bucket", "n", "mean_loss", rate.alias("tok_per_sec"), duration(left).alias("eta"))


@query("tumbling_steps", _STEPS + """, x AS (SELECT event_type, max(step) AS steps, min(epoch(ts)) AS beginning FROM s GROUP BY 1), b AS (SELECT event_type, ((step - 1) // 100)::INT AS bucket, round(avg(value), 6) AS mean_loss, count(*) AS n, sum(user_id) AS tokens, max(epoch(ts)) AS now, max(step) AS final FROM s GROUP BY 1, 2),
d AS (SELECT *, now - coalesce(lag(now) OVER (PARTITION BY event_type ORDER BY bucket), beginning) AS spent FROM b JOIN x USING (event_type)), e AS (SELECT *, trunc((steps - final) * spent / 100)::BIGINT AS rest FROM d)
SELECT event_type, bucket, n, mean_loss, round(tokens / greatest(spent, 1e-6), 1) AS tok_per_sec, (rest // 60) || 'm ' || (rest % 60) || 's' AS eta FROM e""")
def tumbling_steps(t):
    return log_lines(_steps(t), "event_type", "value", "user_id", "ts", 100)


@query("every_kth", _STEPS + ", k AS (SELECT event_type, greatest(1, count(*) // 20) AS k FROM s GROUP BY 1) SELECT event_type, step, value FROM s JOIN k USING (event_type) WHERE (step - 1) % k = 0")
def every_kth(t):
    s = _steps(t)
    k = s.groupBy("event_type").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 20)).alias("k"))
    return s.join(k, "event_type").where((F.col("step") - 1) % F.col("k") == 0).select("event_type", "step", "value")


@query("best_step", _STEPS + " SELECT event_type, step, value FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, step) = 1")
def best_step(t):
    best = F.min(F.struct("value", "step"))
    return _steps(t).groupBy("event_type").agg(best.alias("b")).select("event_type", "b.step", "b.value")


@query("run_kpis", _STEPS + " SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, min_by(value, step) AS first, max_by(value, step) AS last, round(100 * (min_by(value, step) - max_by(value, step)) / nullif(min_by(value, step), 0), 6) AS drop_pct FROM s GROUP BY 1")
def run_kpis(t):
    a, z = F.min_by("value", "step"), F.max_by("value", "step")
    return _steps(t).groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), a.alias("first"), z.alias("last"), F.round(100 * (a - z) / F.nullif(a, F.lit(0.0)), 6).alias("drop_pct"))


@query("loss_histogram", "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT greatest(0, ceil((value - lo) / nullif(hi - lo, 0) * 20)::INT - 1) AS bin, count(*) AS n FROM events, b GROUP BY 1")
def loss_histogram(t):
    b = t.events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return t.events.crossJoin(F.broadcast(b)).groupBy(equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), 20).alias("bin")).agg(F.count("*").alias("n"))


@query("bucket_heatmap", _STEPS + ", b AS (SELECT min(step)::DOUBLE AS lo, max(step)::DOUBLE AS hi FROM s) SELECT event_type, greatest(0, ceil((step - lo) / nullif(hi - lo, 0) * 20)::INT - 1) AS bin, round(avg(value), 6) AS mean FROM s, b GROUP BY 1, 2")
def bucket_heatmap(t):
    s = _steps(t)
    b = s.agg(F.min("step").cast("double").alias("lo"), F.max("step").cast("double").alias("hi"))
    return s.crossJoin(F.broadcast(b)).groupBy("event_type", equal_width_bin(F.col("step"), F.col("lo"), F.col("hi"), 20).alias("bin")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("corr_matrix", _STEPS + " SELECT event_type, round(corr(value, user_id), 6) AS value_user, round(corr(value, step), 6) AS value_step, round(corr(user_id, step), 6) AS user_step FROM s GROUP BY 1")
def corr_matrix(t):
    c = lambda a, b, n: F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(n)
    return _steps(t).groupBy("event_type").agg(c("value", "user_id", "value_user"), c("value", "step", "value_step"), c("user_id", "step", "user_step"))


_OBS = "WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"


def _observations(t) -> DataFrame:
    """A user's events in order as observations: error = ERROR, purchase = PASS, signup = the solution-ok mark."""
    return t.events.select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


@query("repeat_same_error", _OBS + " SELECT user_id, count(*) FILTER (event_type = 'error' AND prev = 'error') AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS prev FROM o) GROUP BY 1")
def repeat_same_error(t):
    prev = F.lag("event_type").over(W.partitionBy("user_id").orderBy("pos"))
    return _observations(t).withColumn("prev", prev).groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("prev") == "error")).alias("n"))


@query("error_streaks", _OBS + ", g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY pos) AS island FROM o), r AS (SELECT user_id, island, count(*) AS len FROM g WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, sum(len // 3)::BIGINT AS fired FROM r GROUP BY 1")
def error_streaks(t):
    """How often three errors in a row were reached, counting anew after each three."""
    w = W.partitionBy("user_id", F.col("event_type") == "error").orderBy("pos")
    runs = _observations(t).withColumn("island", F.col("pos") - F.row_number().over(w)).where("event_type = 'error'").groupBy("user_id", "island").agg(F.count("*").alias("len"))
    return runs.groupBy("user_id").agg(F.sum(F.floor(F.col("len") / 3)).cast("bigint").alias("fired"))


@query("retry_after_pass", _OBS + " SELECT user_id, min(pos) FILTER (event_type = 'purchase')::INT AS first_pass, coalesce(max(pos) > min(pos) FILTER (event_type = 'purchase'), false) AS retried FROM o GROUP BY 1")
def retry_after_pass(t):
    first = F.min(F.when(F.col("event_type") == "purchase", F.col("pos")))
    return _observations(t).groupBy("user_id").agg(first.alias("first_pass"), F.coalesce(F.max("pos") > first, F.lit(False)).alias("retried"))


@query("call_repeat_stop", _OBS + " SELECT user_id, min(pos) FILTER (k = 4)::INT AS stop_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS k FROM o) GROUP BY 1")
def call_repeat_stop(t):
    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("pos"))
    return _observations(t).withColumn("k", k).groupBy("user_id").agg(F.min(F.when(F.col("k") == 4, F.col("pos"))).alias("stop_at"))


@query("sol_ok_after_error", _OBS + ", s AS (SELECT *, last_value(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM o) SELECT user_id, count(*) FILTER (event_type = 'signup' AND state = 1) AS n FROM s GROUP BY 1")
def sol_ok_after_error(t):
    state = F.last(F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 0), ignorenulls=True)
    w = W.partitionBy("user_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return _observations(t).withColumn("state", state.over(w)).groupBy("user_id").agg(F.count_if((F.col("event_type") == "signup") & (F.col("state") == 1)).alias("n"))


@query("repeat_call_after_error", _OBS + " SELECT user_id, count(*) FILTER (prev = 'error' AND before = event_type AND event_type <> 'error') AS n FROM (SELECT *, lag(event_type) OVER w AS prev, lag(event_type, 2) OVER w AS before FROM o WINDOW w AS (PARTITION BY user_id ORDER BY pos)) GROUP BY 1")
def repeat_call_after_error(t):
    w = W.partitionBy("user_id").orderBy("pos")
    o = _observations(t).withColumn("prev", F.lag("event_type").over(w)).withColumn("before", F.lag("event_type", 2).over(w))
    return o.groupBy("user_id").agg(F.count_if((F.col("prev") == "error") & (F.col("before") == F.col("event_type")) & (F.col("event_type") != "error")).alias("n"))


_CAND = """WITH c AS (SELECT user_id, ts::DATE AS day, bool_or(event_type = 'purchase') AS passed, bool_or(event_type = 'signup') AS critique, count(*) FILTER (event_type = 'click') > 0 AS answer, bool_or(r <= 4 AND event_type IN ('click', 'view')) AS last_ok, count(*) FILTER (event_type <> 'error') - count(*) FILTER (event_type = 'error') AS net, count(*) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS idx FROM c), f AS (SELECT *, min(idx) FILTER (passed) OVER (PARTITION BY user_id) AS stop FROM i)"""


@query("best_of_n", _CAND + " SELECT user_id, idx::INT AS idx FROM f WHERE stop IS NULL OR idx <= stop QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY passed DESC, critique DESC, answer DESC, last_ok DESC, net DESC, steps, idx) = 1")
def best_of_n(t):
    """The best of a user's days by six keys, one of them whether one of the last four calls ran code (click, view) well; days after the first that passed were never tried; the first wins ties."""
    e = F.col("event_type")
    w = W.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id"))
    c = t.events.withColumn("day", F.to_date("ts")).withColumn("r", F.row_number().over(w)).groupBy("user_id", "day").agg(
        F.bool_or(e == "purchase").alias("passed"), F.bool_or(e == "signup").alias("critique"), (F.count_if(e == "click") > 0).alias("answer"),
        F.bool_or((F.col("r") <= 4) & e.isin("click", "view")).alias("last_ok"), (F.count_if(e != "error") - F.count_if(e == "error")).alias("net"), F.count("*").alias("steps"),
    )
    c = c.withColumn("idx", F.row_number().over(W.partitionBy("user_id").orderBy("day")))
    c = c.withColumn("stop", F.min(F.when(F.col("passed"), F.col("idx"))).over(W.partitionBy("user_id"))).where("stop is null or idx <= stop")
    rank = F.struct("passed", "critique", "answer", "last_ok", "net", (-F.col("steps")).alias("a"), (-F.col("idx")).alias("b"))
    return c.groupBy("user_id").agg(F.max_by("idx", rank).alias("idx"))


def begins(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """df with begin = the sizes of all rows of its group before it, in order; order must be unique in a group. Two
    levels of prefix sums, so a group may be any size."""
    dealt = _dealt(df, [group, order], "begins").withColumn("_p", F.expr(f"shiftright(_m, {_BITS})"))
    inner = F.sum(size).over(W.partitionBy("_p", group).orderBy("_m")) - F.col(size)
    totals = dealt.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.sum(size).alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(W.partitionBy("_g").orderBy("_q")) - F.col("_n")).drop("_n")
    joined = dealt.withColumn("_inner", inner).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("begin", F.col("_inner") + F.col("_before")).drop("_m", "_p", "_g", "_q", "_inner", "_before")


@query("pack_chunks", """WITH d AS (SELECT source, doc_id, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents),
s AS (SELECT source, string_agg(text, '' ORDER BY doc_id) AS all_text FROM documents GROUP BY 1),
c AS (SELECT source, all_text, unnest(range((length(all_text) - 1) // 256)) AS chunk FROM s)
SELECT source, chunk::BIGINT AS chunk, md5(substr(all_text, chunk * 256 + 1, 257)) AS ids_md5 FROM c""")
def pack_chunks(t):
    """Windows of 257 code points with stride 256 over each source's texts in doc_id order; the tail is dropped.

    Each text is cut at window borders where it lies in its source's stream, so only pieces meet in a window.
    """
    sizes = t.documents.select("source", "doc_id", F.length("text").alias("n")).where("n > 0")
    d = t.documents.select("doc_id", "text").join(begins(sizes, "source", "doc_id", "n"), "doc_id")
    last = F.floor((F.col("begin") + F.col("n") - 1) / 256)
    first = F.greatest(F.lit(0), F.floor((F.col("begin") - 1) / 256))
    p = d.withColumn("chunk", F.explode(F.sequence(first, last)))
    at = F.greatest(F.col("chunk") * 256 - F.col("begin"), F.lit(0)).cast("int")
    stop = F.least(F.col("chunk") * 256 + 257 - F.col("begin"), F.col("n")).cast("int")
    p = p.select("source", "chunk", "begin", F.substring("text", at + 1, stop - at).alias("part"))
    joined = p.groupBy("source", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"]), "").alias("ids"))
    return joined.where(F.length("ids") == 257).select("source", "chunk", F.md5(F.col("ids").cast("binary")).alias("ids_md5"))


@query("nucleus_cut", "WITH p AS (SELECT source, doc_id, n_chars / sum(n_chars) OVER (PARTITION BY source) AS p FROM documents), c AS (SELECT *, sum(p) OVER (PARTITION BY source ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) - p AS before FROM p), k AS (SELECT * FROM c WHERE round(before, 9) <= 0.9) SELECT source, doc_id, round(p / sum(p) OVER (PARTITION BY source), 6) AS p FROM k")
def nucleus_cut(t):
    """Of each source, the largest texts until those before hold nine tenths of it; their shares, made whole."""
    d = t.documents.select("source", "doc_id", "n_chars")
    total = d.groupBy("source").agg(F.sum("n_chars").alias("total"))
    ordered = begins(d.withColumn("_o", F.struct((-F.col("n_chars")).alias("a"), "doc_id")), "source", "_o", "n_chars")
    kept = ordered.join(total, "source").where(F.round(F.col("begin") / F.col("total"), 9) <= 0.9)
    share = F.col("n_chars") / F.col("kept")
    return kept.join(kept.groupBy("source").agg(F.sum("n_chars").alias("kept")), "source").select("source", "doc_id", F.round(share, 6).alias("p"))


@query("char_tokens", "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c) % 256), ' ')) AS ids_md5 FROM documents WHERE length(text) > 0")
def char_tokens_query(t):
    ids = char_tokens(F.col("text"), 256)
    return t.documents.where("length(text) > 0").select("doc_id", F.md5(F.array_join(ids.cast("array<string>"), " ").cast("binary")).alias("ids_md5"))


#: Warm-up steps, all steps, and the least factor, of four schedules.
SCHEDULES = {"pretrain": (100, 1000, 0.0), "code": (50, 800, 0.1), "distil": (20, 500, 0.0), "vision": (0, 300, 0.0)}


def lr_factor(step: Column, warm_up: int, total: int, least: float) -> Column:
    """A linear warm-up, then half a cosine down to least."""
    progress = (step - warm_up) / max(total - warm_up, 1)
    return F.when(step < warm_up, step / max(warm_up, 1)).otherwise(F.greatest(F.lit(least), 0.5 * (1 + F.cos(F.pi() * progress))))


@query("lr_schedule", " UNION ALL ".join(f"SELECT '{k}' AS schedule, i AS step, round(CASE WHEN i < {w} THEN i / {max(w, 1)} ELSE greatest({low}, 0.5 * (1 + cos(pi() * (i - {w}) / {n - w}))) END, 6) + 0.0 AS lr FROM range({n + 50}) r(i)" for k, (w, n, low) in SCHEDULES.items()))
def lr_schedule(t):
    parts = [t.spark.range(n + 50).select(F.lit(k).alias("schedule"), F.col("id").alias("step"), (F.round(lr_factor(F.col("id"), w, n, low), 6) + 0.0).alias("lr")) for k, (w, n, low) in SCHEDULES.items()]
    return reduce(DataFrame.unionByName, parts)


@query("fmt_duration", "SELECT event_id, (event_id // 60)::VARCHAR || 'm ' || (event_id % 60) || 's' AS took FROM events")
def fmt_duration(t):
    return t.events.select("event_id", duration(F.col("event_id")).alias("took"))


@query("perplexity", "SELECT lang, round(exp(sum(ln(n_chars + 1) * n_chars) / sum(n_chars)), 4) AS ppl FROM documents GROUP BY 1")
def perplexity(t):
    n = F.col("n_chars")
    return t.documents.groupBy("lang").agg(F.round(F.exp(F.sum(F.log(n + 1) * n) / F.sum(n)), 4).alias("ppl"))


@query("stream_shard", "SELECT doc_id, doc_id % 4 AS shard FROM documents WHERE length(text) > 0 AND doc_id % 4 = 1")
def stream_shard(t):
    return t.documents.where("length(text) > 0").select("doc_id", F.pmod("doc_id", F.lit(4)).alias("shard")).where("shard = 1")


@query("heldout_slice", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) JOIN documents USING (doc_id) WHERE r > 50 AND length(text) > 257 ORDER BY doc_id LIMIT 100")
def heldout_slice(t):
    """Skips 50 documents, then takes the first 100 that are long enough."""
    indexed = global_index(t.documents.select("doc_id", F.length("text").alias("n")), "doc_id", "r")
    return indexed.where("r >= 50 and n > 257").orderBy("doc_id").limit(100).select("doc_id")
