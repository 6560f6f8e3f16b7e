"""Centroid clustering: against SQL and Python's own integers, close calls, odd tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
from tessera.llm import centroids

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, dims=64, scale=64, k=16, rounds=3):
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, [math.floor(scale * x) for x in v], v) for i, v in fine]
    order = sorted(fine, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    c = [v for _, v, _ in order[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [place(v)[1] for _, v, _ in fine]
        for j in range(len(c)):
            own = [v for (_, v, _), o in zip(fine, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    last = [place(v) for _, v, _ in fine]
    sums = [sum(d for d, o in last if o == j) for j in range(len(c))]
    return sorted(((i, o, d, sums[o], sum(sums), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _, _), (d, o) in zip(fine, last)), key=repr)


def run(spark, rows, **more):
    return sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()), key=repr)


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got, want = centroids.op13_centroids(spark, SF), con.execute(centroids.OP13_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_close_calls_ties_and_bad_vectors(spark):
    rng = random.Random(3)
    grid = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]
    rows = [(i, grid()) for i in range(300)] + [(5, grid()), (5, [0.5] * 4), (None, grid()), (None, [9.0] * 4)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [1.0, float("nan"), 1.0, 1.0]), (906, [1.0, float("inf"), 0.0, 0.0])]
    got = run(spark, rows, dims=4, scale=1, k=7)
    assert got == plain(rows, 4, 1, 7)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.25] * 64), (2, [0.25] * 64), (3, [-1.0] * 64)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_intervals_hold_the_true_value_and_leave_few_open():
    rng = np.random.default_rng(0)
    for size in (3, 1000, centroids.LIMIT - 1):
        x, c = rng.integers(-size, size + 1, (500, 64)), rng.integers(-size, size + 1, (16, 64))
        low, high = centroids.intervals(x, c)
        true = [[int(sum(int(b) ** 2 for b in w)) - 2 * sum(int(a) * int(b) for a, b in zip(v, w)) for w in c] for v in x]
        assert all(lo <= t <= hi for lo, t, hi in zip(low.ravel().tolist(), (t for r in true for t in r), high.ravel().tolist()))
        cluster, distance, left = centroids.assign(x, c)
        own = [sum(int(a) ** 2 for a in v) for v in x]
        assert list(zip(distance.tolist(), cluster.tolist())) == [min((o + t, j) for j, t in enumerate(r)) for o, r in zip(own, true)]
        assert left < 250 or size == 3


def test_near_ties_of_large_numbers_are_decided_exactly():
    base = np.full((1, 64), centroids.LIMIT - 3, np.int64)
    c = np.repeat(base, 5, axis=0)
    c[0, 0] -= 2
    c[1:4, 1] -= 1
    cluster, distance, left = centroids.assign(base, c[:4])
    assert (cluster[0], distance[0], left) == (1, 1, 1)
    cluster, distance, _ = centroids.assign(base, c)
    assert (cluster[0], distance[0]) == (4, 0)


def test_clashing_columns_and_too_large(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0], 3, "x")], "cluster bigint, v array<double>, id int, total string")
    out = centroids.cluster(df, "cluster", "v", dims=2)
    assert out.columns[0] == "_cluster" and out.first()[0] == 7
    try:
        run(spark, [(1, [3e6] * 64)])
        raise RuntimeError("no error")
    except Exception as e:
        assert "don't fit a long" in str(e)
