"""Row numbers and moving windows on many rows and wide columns, and short runs."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import sequence
from tessera.operators.memory import dense_topk
from tessera.operators.sequence import begins, global_index, numbered


@pytest.fixture(scope="module")
def wide(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    yield spark.range(0, 400_000, 1, 16).select(F.xxhash64("id").alias("h"), F.repeat(F.col("id").cast("string"), 16).alias("wide"), (F.col("id") % 3).alias("run"))
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_no_row_is_lost(wide):
    out = global_index(wide, "h", "i")
    n, least, most, distinct = out.agg(F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i")).first()
    assert (n, least, most, distinct) == (400_000, 0, 399_999, 400_000)
    rows = out.where("i < 50").orderBy("i").select("h", "wide").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in wide.orderBy("h").limit(50).select("h", "wide").collect()]


def test_places_in_runs(wide):
    out = numbered(wide, "run", ["h"], "step").groupBy("run").agg(F.count("*").alias("n"), F.min("step").alias("a"), F.max("step").alias("z"), F.count_distinct("step").alias("d")).collect()
    assert all((r.n, r.a, r.z, r.d) == (r.n, 1, r.n, r.n) for r in out) and sum(r.n for r in out) == 400_000


def test_prefix_sums(spark):
    rows = [(i % 3, i, i * i % 11) for i in range(500)]
    out = begins(spark.createDataFrame(rows, "g int, o int, n int").repartition(7), "g", "o", "n").collect()
    for r in out:
        assert r.begin == sum(n for g, o, n in rows if g == r.g and o < r.o)


def test_windows_over_block_borders(spark, monkeypatch):
    rows = [(g, k + 1, float((k * 7 + g) % 13)) for g in range(2) for k in range(100)]
    steps = spark.createDataFrame(rows, "run int, step bigint, v double").repartition(5)
    monkeypatch.setattr(sequence.blocks, "__defaults__", (8,))
    got = {(r.run, r.step): r.m for r in sequence.rolling(steps, "run", "v", 10, "m").collect()}
    assert len(got) == 200
    for g, k, _ in rows:
        seen = [v for h, j, v in rows if h == g and k - 10 < j <= k]
        assert got[g, k] == pytest.approx(sum(seen) / len(seen))


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 10, 11, 30])
def test_smoothing_of_a_parabola_is_exact(spark, n):
    f = lambda k: 2.0 + 3 * k - 0.5 * k * k
    steps = spark.createDataFrame([("a", k, f(k)) for k in range(1, n + 1)], "run string, step bigint, v double")
    got = {r.step: r.s for r in sequence.savgol(steps, "run", "v", "s").collect()}
    for k in range(1, n + 1):
        near = [f(j) for j in range(max(1, k - 1), min(n, k + 1) + 1)]
        assert got[k] == pytest.approx(f(k) if n > 4 else sum(near) / len(near))


def test_dense_search_with_ties_nulls_and_blocks(spark, monkeypatch):
    from tessera.operators import memory

    monkeypatch.setattr(memory, "QUERY_BLOCK", 3)
    rows = [(i, [float(i % 4), 1.0]) for i in range(40)] + [(None, [1.0, 1.0]), (99, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(3)
    got = {}
    for r in dense_topk(df, df.where("id < 8"), "id", "v", 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.id))
    for q in range(8):
        best = sorted((i for i in range(40) if i != q), key=lambda i: (-((i % 4) * (q % 4) + 1), i))[:3]
        assert sorted(got[q]) == list(zip((1, 2, 3), best))
    assert dense_topk(df, df.where("id < 0"), "id", "v", 3).count() == 0


def test_batches_put_only_lengths_in_order(spark, monkeypatch):
    from tessera.operators import sequence
    from tessera.operators.samples import padded_batches

    kinds, stored = [], sequence.stored
    monkeypatch.setattr(sequence, "stored", lambda df, name: kinds.extend(f.dataType.typeName() for f in df.schema) or stored(df, name))
    rows = spark.createDataFrame([(1, [5, 6]), (1, [7, 8]), (None, [9]), (2, None), (3, [1, 2, 3])], "k int, ids array<int>").withColumn("labels", F.col("ids"))
    got = padded_batches(rows, "k", "ids", "labels", 2).select("k", "batch", "width", "pad", "ids", "labels").collect()
    assert "array" not in kinds
    assert sorted((r.k or 0, r.batch, r.width, r.pad, r.ids, r.labels[-1]) for r in got) == sorted([(0, 0, 1, 0, [9], 9), (2, 0, 1, 1, [0], -100), (3, 2, 3, 0, [1, 2, 3], 3), (1, 1, 2, 0, [5, 6], 6), (1, 1, 2, 0, [7, 8], 8)])
