"""Stored indexes: by tag, against plain code, what is replaced, what is missing, and what a search passes over."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tessera.plans.storage import stored
from tessera.store import embedder, memory_index, sparse
from tessera.store.memory_index import load_index, save_index
from tessera.store.sparse import Sparse

keep = lambda df, name, by=None: stored(df, name)


def terms(t):
    w = (t or "").lower().split()
    return Counter(w + [f"{a}_{b}" for a, b in zip(w, w[1:])])


def plain(docs, queries, k):
    n, df = len(docs), Counter(x for t in docs.values() for x in terms(t))
    length = lambda w: math.sqrt(sum(v * v for v in w.values()))
    wd = {i: {x: c * (math.log((n + 1) / (df[x] + 1)) + 1) for x, c in terms(t).items()} for i, t in docs.items()}
    out = []
    for q, t in queries.items():
        wq = {x: c * (math.log((n + 2) / (df[x] + 2)) + 1) for x, c in terms(t).items() if df[x]}
        scored = [(-round(sum(v * d[x] for x, v in wq.items() if x in d) / length(d) / length(wq), 9), i) for i, d in wd.items() if any(x in d for x in wq)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(rng, n):
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    text = lambda m: " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(m))
    docs = {i: text(rng.randint(1, 30)) for i in range(n)}
    docs[n], docs[n + 1], docs[n + 2] = docs[0], docs[0], ""
    queries = {i: text(rng.randint(1, 12)) for i in range(15)} | {90: "nothing known here", 91: "", 92: docs[3], 93: "c1"}
    return docs, queries


@pytest.mark.parametrize(("seed", "size"), [(4096, None), (40, None), (40, 0), (40, 10**9), (0, None)])
def test_searches_against_plain_code(spark, tmp_path, monkeypatch, seed, size):
    """size: of the postings, as the search takes it: with none, what is left is read by row, with many by list."""
    monkeypatch.setattr(sparse, "SEED", seed)
    docs, queries = corpus(random.Random(3), 300)
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    asked = spark.createDataFrame(list(queries.items()), "q int, text string")
    save_index(df, "id", "text", f"file://{tmp_path}/i")
    index = load_index(spark, f"file://{tmp_path}/i")
    assert index.backend == "tfidf"
    if size is not None:
        index._in.size = size
    got = index.search(asked.withColumnRenamed("text", "asked"), "q", "asked", 4).select("q", "rank", "id", F.round("score", 9)).collect()
    assert sorted(map(tuple, got)) == plain(docs, queries, 4)


def test_frequent_terms_of_sure_hits_are_passed_over(spark):
    rng = random.Random(4)
    docs = {i: " ".join(["the", "of", "and"] + [f"w{rng.randint(0, 3000)}" for _ in range(12)]) for i in range(800)}
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    tables = []
    index = Sparse.build(df, "id", "text", keep, buckets=4)
    asked = df.where("id < 3").select(F.col("id").alias("q"), "text")
    hits = index.search(asked, "q", "text", 1, lambda d, name, by=None: tables.append((name, stored(d, name))) or tables[-1][1])
    assert sorted((r["q"], r["id"]) for r in hits.collect()) == [(0, 0), (1, 1), (2, 2)]
    split = dict(tables)["split"]
    assert split.where("late and term in ('the', 'of', 'and')").count() == 9
    assert index.shares(asked, "q", "text").where("all > 2400").count() == 3


def test_dense_index_by_tag(spark, tmp_path):
    docs, queries = corpus(random.Random(5), 120)
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    asked = spark.createDataFrame(list(queries.items()), "q int, text string")
    at = f"file://{tmp_path}"
    embedder.forget()
    embedder.train(df, "text", f"{at}/model", dims=16)
    model = embedder.open_embedder(spark, f"{at}/model")
    save_index(df, "id", "text", f"{at}/i", model)
    index = load_index(spark, f"{at}/i", model)
    assert index.backend == "projection"
    v = {r.id: r.v for r in df.select("id", model.column(F.col("text")).alias("v")).collect()}
    q = {r.q: r.v for r in asked.select("q", model.column(F.col("text")).alias("v")).collect()}
    want = [(a, r + 1, i, -s) for a, x in q.items() for r, (s, i) in enumerate(sorted((-round(sum(float(g) * float(h) for g, h in zip(x, y)), 9) + 0.0, i) for i, y in v.items())[:3])]
    got = index.search(asked.withColumnRenamed("text", "asked"), "q", "asked", 3).select("q", "rank", "id", F.round("score", 9)).collect()
    assert sorted((a, r, i, round(s, 7) + 0.0) for a, r, i, s in map(tuple, got)) == sorted((a, r, i, round(s, 7) + 0.0) for a, r, i, s in want)
    with pytest.raises(ValueError):
        load_index(spark, f"{at}/i")


def test_missing_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        load_index(spark, path)
    for rows in ([(5, "a b"), (3, "a c")], [(9, "z")]):
        save_index(spark.createDataFrame(rows, "id int, text string"), "id", "text", path)
        index = load_index(spark, path)
        assert [(r["vec_index"], r["id"]) for r in index.records.orderBy("vec_index").collect()] == [(i, r[0]) for i, r in enumerate(sorted(rows))]
    save_index(spark.createDataFrame([], "id int, text string"), "id", "text", path)
    assert load_index(spark, path).search(spark.createDataFrame([(1, "a")], "q int, asked string"), "q", "asked", 4).count() == 0
    memory_index.Folder(spark, path).delete(memory_index.MANIFEST)
    with pytest.raises(FileNotFoundError):
        load_index(spark, path)


def test_an_index_keeps_postings_once(spark):
    docs, _ = corpus(random.Random(7), 60)
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    names = []
    index = Sparse.build(df, "id", "text", lambda d, name, by=None: names.append((name, d.columns)) or stored(d, name), buckets=3)
    assert [name for name, columns in names if "term" in columns] == ["postings", "terms"] and dict(names)["forward"] == ["id", "ws", "size"]
    assert {(r.term, r.df) for r in index.terms.collect()} == set(Counter(x for t in docs.values() for x in terms(t)).items())
    assert index.size == sum(len(terms(t)) for t in docs.values())


def test_postings_are_lists_sent_in_packs(spark, monkeypatch):
    docs, _ = corpus(random.Random(8), 90)
    df = spark.createDataFrame([(i * 70_001 - 9, t) for i, t in docs.items()], "id bigint, text string").repartition(3)
    want = {x: {i * 70_001 - 9: c for i, t in docs.items() for y, c in terms(t).items() if y == x} for x in {x for t in docs.values() for x in terms(t)}}
    index = Sparse.build(df, "id", "text", keep, buckets=3)
    assert {r.term: dict(zip(r.ids, r.tfs)) for r in index.postings.collect()} == want and index.postings.count() == len(want)
    sent = sparse.packs(sparse.one_a_key(df, "id", "text"), 3).toArrow()
    assert len(sent) <= 3 * 3  # a slice and bucket
    monkeypatch.setattr(sparse, "LONG", 4)
    rows = sparse.lists_of_bucket(sent.filter(sparse.pc.equal(sent["bucket"], 1))).to_pylist()
    assert max(len(r["ids"]) for r in rows) == 4 and rows == sorted(rows, key=lambda r: (r["term"], r["part"]))
    whole = {}
    for r in rows:
        assert r["df"] == len(want[r["term"]]) and sparse.crc32(r["term"].encode()) % 3 == 1
        whole.setdefault(r["term"], {}).update(zip(r["ids"], r["tfs"]))
    assert whole == {x: d for x, d in want.items() if sparse.crc32(x.encode()) % 3 == 1}


def test_texts_are_written_once(spark, tmp_path, monkeypatch):
    """Beside the words of the index; before, a table in order was stored for the numbers, and then the records."""
    from tessera.operators import sequence

    monkeypatch.setattr(sequence, "stored", None)
    df = spark.createDataFrame([(i * 7 % 50, f"t{i}") for i in range(50)], "id int, text string").repartition(5)
    save_index(df, "id", "text", f"file://{tmp_path}/i")
    assert [tuple(r) for r in load_index(spark, f"file://{tmp_path}/i").records.select("vec_index", "id").orderBy("id").collect()] == [(i, i) for i in range(50)]


def test_long_tables_of_lengths_meet_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sparse, "SENT", 0)
    docs, queries = corpus(random.Random(9), 120)
    index = Sparse.build(spark.createDataFrame(list(docs.items()), "id int, text string"), "id", "text", keep, buckets=2)
    got = index.search(spark.createDataFrame(list(queries.items()), "q int, text string"), "q", "text", 4, keep)
    assert sorted((r.q, r.rank, r.id, round(r.score, 9)) for r in got.collect()) == plain(docs, queries, 4)
