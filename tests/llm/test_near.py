"""Near-duplicate classes: recall against all pairs, document frequencies, odd ids."""

import random
from collections import Counter, defaultdict

import numpy as np
from tessera.llm import near_dedup

SF = "/root/testdata/sf0.01"


def own_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def similar_pairs(texts, least=0.8):
    """All pairs of texts (id -> text) whose plain sets of five-word shingles reach least, by an index of all shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter()
    for ids in where.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                shared[j, i] += 1
    return [(i, j) for (i, j), n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)]


def recall(spark, sf_dir):
    """(pairs that reach 0.8, those in one class)"""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    label = {r.doc_id: r.class_id for r in near_dedup.op1_near_dedup(spark, sf_dir).collect()}
    pairs = similar_pairs(texts)
    return len(pairs), sum(label[i] == label[j] for i, j in pairs)


def test_recall_against_all_pairs(spark):
    pairs, found = recall(spark, SF)
    print(f"{found} of {pairs} pairs")
    assert pairs > 50 and found >= 0.95 * pairs


def test_document_frequencies(spark):
    texts = ["the same the", "the other", None, "", "the the the", *["x the"] * 3]
    df = spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(3)
    got = near_dedup.rarity(df)
    h, _ = near_dedup.words(["the", "x", "same", "unknown"])
    want = [np.log((1 + 8) / (1 + d)) + 1 for d in (6, 3, 1, 1)]
    assert np.allclose(got.of(h), want)


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c = (own_words(rng, 120) for _ in range(3))
    near = lambda t: t.replace(t.split()[60], "changed")
    rows = [(5, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (7, a), (7, own_words(rng, 50)), (8, c), (9, None), (None, None), (10, "z " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, print int, keys string").repartition(3)
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_dedup(df).collect()), key=repr)
    # a, its near copy and the row of id 7 that repeats it are one class; so are the two texts c.
    want = [(5, 5), (None, 5), (None, None), (None, None), (7, 7), (7, 5), (7, 7), (8, 7), (9, 9), (None, None), (10, 10)]
    assert got == sorted(want, key=repr)
