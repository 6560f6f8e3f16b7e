"""Containment, blends, gates, merged indexes and long n-gram precision against plain code."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators.containment import contained
from tessera.operators.curate import blends, gated_pool, pool_order
from tessera.operators.training import long_precision
from tessera.store.memory_index import merged


def _texts(seed: int, n: int, most: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", "ab", "é", "ba"]) + r.choice([" ", " ", "\n"]) for _ in range(r.randint(0, most)))[: r.randint(0, 3 * most)] for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_contained(spark, shard_bytes):
    texts = _texts(1, 60, 60) + [None, "", "a b ab ba é a b ab ba é"]
    r = random.Random(2)
    cut = lambda t, n: t[(i := r.randint(0, max(0, len(t) - n))) : i + n]
    items = [cut(t, r.choice([1, 2, 5, 9, 20, 40, 60])) for t in texts if t for _ in range(3)] + [None, "", "zz", "a", "a", "xb ab ba é a b ab ba é a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("item", F.lit(0))
    got = contained(docs, "doc_id", "text", spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), "item_id", "text", shard_bytes)
    want = sorted((i, d) for i, item in enumerate(items) for d, text in enumerate(texts) if item and text and item in text)
    assert sorted(map(tuple, got.collect())) == want
    assert any(len(items[i].split()) > 9 for i, _ in want) and any(len(items[i].split()) < 3 for i, _ in want)


def test_nothing_is_contained_in_nothing(spark):
    none, some = spark.createDataFrame([], "k string, t string"), spark.createDataFrame([("x", "a b")], "k string, t string")
    assert contained(none, "k", "t", some.select(F.col("k").alias("i"), "t"), "i", "t").count() == 0
    assert contained(some, "k", "t", none.select(F.col("k").alias("i"), "t"), "i", "t").count() == 0
    assert contained(some, "k", "t", some.select(F.col("k").alias("i"), "t"), "i", "t").collect() == [("x", "x")]


@pytest.mark.parametrize("n", [0, 7])
def test_blends(spark, n):
    base = spark.range(n).withColumn("part", F.lit("base"))
    pool = pool_order(spark.range(100, 130).withColumn("part", F.lit("pool")), "id")
    order = [r["id"] for r in pool.orderBy("_r").collect()]
    shares = [0.0, 0.3, 0.5, 0.9, 1.0]
    got = {s: set() for s in shares}
    for r in blends(base, pool, shares).collect():
        got[r.share].add(r.id)
    for s in shares:
        most = 0 if s == 0 else len(order) if s == 1 else math.ceil(s * n / (1 - s))
        assert got[s] == set(range(n)) | set(order[:most])


def test_a_pool_out_of_bounds_is_an_error(spark):
    pool = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "kind string")
    assert gated_pool(pool, "kind", 0.4, 0.6, 4).count() == 10
    with pytest.raises(ValueError, match="^b: count out of bounds$"):
        gated_pool(pool, "kind", 0.4, 0.6, 5)
    with pytest.raises(ValueError, match="a: share and count out of bounds; b: share and count out of bounds"):
        gated_pool(pool, "kind", 0.45, 0.5, 7)
    with pytest.raises(ValueError, match="empty"):
        gated_pool(pool.where("false"), "kind", 0, 1, 0)


def test_files_of_merged_parts_stay_apart(spark):
    rows = spark.createDataFrame([("f", 1), ("g", 2)], "file string, n int")
    assert sorted(map(tuple, merged({"": rows, "repair": rows}).collect())) == [("f", 1), ("g", 2), ("repair_f", 1), ("repair_g", 2)]


def test_precision_of_long_texts(spark):
    r = random.Random(3)
    pairs = [(" ".join(r.choices("ab", k=r.randint(0, 40))), " ".join(r.choices("aB", k=r.randint(0, 40)))) for _ in range(30)] + [("", ""), ("a b", ""), ("a b " * 20000, "A  b\n" * 15000), (None, "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, c string, r string")
    grams = lambda t: Counter(zip(w := (t or "").lower().split(), w[1:]))
    want = {i: (sum((a & b).values()) / a.total() if a else 0.0) for i, (c, d) in enumerate(pairs) for a, b in [(grams(c), grams(d))]}
    got = {x.id: x.p for x in long_precision(df, "id", F.col("c"), F.col("r"), 2).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_precision_is_counted_in_the_tasks_that_read_the_texts(spark, n):
    r = random.Random(n)
    texts = lambda m: " ".join(r.choices(["a", "B", "ab", "b a", "é"], k=r.randint(0, m)))
    long = ["a b " * 20000 + texts(9) for _ in range(30)]  # more words than are counted at once
    pairs = [(texts(12), texts(12)) for _ in range(60)] + [(t, t[: len(t) // 2]) for t in long] + [("", "a"), ("a", None), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, c string, r string")
    grams = lambda t: Counter(zip(*((t or "").lower().split()[i:] for i in range(n))))
    want = {i: (sum((a & b).values()) / a.total() if a else 0.0) for i, (c, d) in enumerate(pairs) for a, b in [(grams(c), grams(d))]}
    told = lambda rows: long_precision(rows, "id", F.col("c"), F.col("r"), n)
    assert "Exchange" not in told(df)._jdf.queryExecution().executedPlan().toString()
    assert {x.id: x.p for x in told(df.coalesce(1)).collect()} == pytest.approx(want)


def test_bigram_precision_of_odd_rows(spark, tmp_path):
    texts = ["a b a b c of the a b", "of the of the", "a\x0bb c a\x0bb c", "a\x0bb c a b c a b c", " \t\n", "", None, "x", "a b c d a b c d"]
    texts.append(" ".join(f"w{i:03}" for i in range(641)) + "-" * 36)  # 323 of its 640 bigrams, a tie at six places
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, "a b a b"), (20, "b a b c d"), (20, None), (21, "a b a b"), (21, "a b a b"), (None, "a b a b"), (None, "a b a b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.plans.QUERIES["bigram_precision"](spark, str(tmp_path)).select("doc_id", "p").collect()
    want = con.execute(entry.plans.SQL["bigram_precision"]).fetchall()
    assert (9, 0.504687) in want
    assert Counter(map(tuple, got)) == Counter(want)
