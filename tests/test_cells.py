"""Cells against a comparison with all vectors; embedder, its artefact and the fallback."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.plans.storage import stored
from tessera.store import cells, embedder
from tessera.store.cells import Cells
from tessera.store.folder import Folder

SF = "/root/testdata/sf0.001"


def brute(ids, x, asked, k):
    out = []
    for q in asked:
        s = np.round(x @ x[list(ids).index(q)], 9)
        order = sorted((-v, i) for v, i in zip(s, ids) if i != q)[:k]
        out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(order)]
    return out


def search(spark, ids, x, asked, k, **more):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, e array<double>")
    index = Cells.build(df, "vec_id", "e", stored, **more)
    hits, compared = index.search(df.where(F.col("vec_id").isin([int(i) for i in asked])), "vec_id", "e", k, stored)
    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 9) + 0.0) for r in hits.collect())
    assert got == sorted((q, r, i, float(s) + 0.0) for q, r, i, s in brute(ids, x, asked, k))
    return (compared.agg(F.sum("compared")).first()[0] or 0) / (len(asked) * len(ids))


def test_clustered_vectors_visit_few_cells(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 16)) * 4
    x = centre[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.1
    assert search(spark, np.arange(1500), x, range(0, 1500, 100), 4) < 0.4


def test_any_vectors_equal_ones_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(cells, "CHUNK", 50)
    monkeypatch.setattr(cells, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * rng.uniform(0, 3, (400, 1))
    x[100:260] = x[100]
    x[300:310] = 0
    ids = rng.permutation(4000)[:400]
    assert search(spark, ids, x, list(ids[::9]), 5) <= 1


@pytest.mark.parametrize("n", [1, 2, 4])
def test_fewer_vectors_than_asked_for(spark, n):
    x = np.random.default_rng(2).normal(size=(n, 4))
    search(spark, np.arange(n), x, range(n), 4, centres=3)


def test_rows_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0]), (2, []), (3, [1.0]), (4, [0.5])], "vec_id bigint, e array<double>")
    index = Cells.build(df, "vec_id", "e", stored)
    hits, _ = index.search(df, "vec_id", "e", 2, stored)
    assert sorted(tuple(r) for r in hits.collect()) == [(3, 1, 4, 0.5), (4, 1, 3, 0.5)]
    none = Cells.build(df.limit(0), "vec_id", "e", stored)
    assert none.search(df, "vec_id", "e", 2, stored)[0].count() == 0


def test_embedder_against_plain_code(spark, tmp_path):
    texts = ["One two two THREE", "two é_1 one", "", None, "x " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    path = f"file://{tmp_path}/model"
    embedder.forget()
    assert embedder.open_embedder(spark, path) is None and embedder.open_embedder(spark, None) is None
    embedder.train(df, "t", path, dims=8, slots=128)
    assert embedder.open_embedder(spark, path) is None  # as found before
    embedder.forget()
    model = embedder.open_embedder(spark, path)
    assert (model.tag, model.dims) == ("projection", 8) and embedder.open_embedder(spark, path) is model

    def terms(t):
        w = (t or "").lower().split()
        return w + [f"{a}_{b}" for a, b in zip(w, w[1:])]

    at = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 128
    df_ = Counter(s for t in texts for s in {at(x) for x in terms(t)})
    for r in df.select("i", model.column(F.col("t"), batch=2).alias("v")).collect():
        want = np.zeros(8)
        for x, n in Counter(terms(texts[r.i])).items():
            s = at(x)
            want[s % 8] += (1 if s // 8 % 2 == 0 else -1) * n * (math.log(6 / (df_[s] + 1)) + 1)
        size = np.linalg.norm(want)
        assert np.allclose(r.v, want / (size if size > 1e-8 else 1), atol=1e-6)
        assert len(r.v) == 8 and (size < 1e-8 or abs(np.linalg.norm(r.v) - 1) < 1e-5)


def test_a_broken_artefact_means_tfidf(spark, tmp_path):
    path = f"file://{tmp_path}/broken"
    Folder(spark, path).commit("embedder.json", '{"tag": "projection", "slots": 4, "dims": 2}')
    embedder.forget()
    assert embedder.open_embedder(spark, path) is None


def test_a_query_is_sent_once_however_many_cells_it_visits(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART", 100)
    monkeypatch.setattr(cells, "LEAST", 100)
    monkeypatch.setattr(cells, "VISITS", 16)
    x = np.random.default_rng(6).normal(size=(500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, e array<double>")
    tables = []
    index = Cells.build(df, "vec_id", "e", stored, chunk=20, block=30)
    hits, _ = index.search(df, "vec_id", "e", 3, lambda d, name: tables.append(stored(d, name)) or tables[-1])
    got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 9) + 0.0) for r in hits.collect())
    assert got == sorted((q, r, i, float(s) + 0.0) for q, r, i, s in brute(range(500), x, range(500), 3))
    assert all(t.count() <= (3 + 1) * 500 for t in tables)


def test_training_sends_a_number_a_slot(spark, tmp_path):
    df = spark.createDataFrame([(f"a b c{i % 7}",) for i in range(300)] + [(None,), ("",)], "t string").repartition(2)
    embedder.train(df, "t", f"file://{tmp_path}/model", dims=4, slots=32)
    at = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 32
    want = Counter(s for i in range(300) for s in {at(x) for x in ("a", "b", f"c{i % 7}", "a_b", f"b_c{i % 7}")})
    got = {r.slot: r.idf for r in spark.read.parquet(f"file://{tmp_path}/model/weights").collect()}
    assert got == pytest.approx({s: math.log(303 / (want[s] + 1)) + 1 for s in range(32)})
