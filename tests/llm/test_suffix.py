"""Repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from tessera.llm import suffix_dedup

SPAN = suffix_dedup.SPAN


def brute(texts):
    seen = Counter(t[i : i + SPAN] for t in texts for i in range(len(t) - SPAN + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - SPAN + 1):
            if seen[t[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append(([tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(150), word(199), word(210), word(900)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "ab" * 400, word(3000), "日本" * 120]
    for _ in range(40):
        texts.append(word(rng.randint(0, 300)) + rng.choice(shared) + word(rng.randint(0, 300)) + rng.choice(shared) + word(rng.randint(0, 50)))
    return texts + [texts[-1], texts[-2], texts[6][:1500] + "!" + texts[6][1501:], "z" + texts[9]]


def test_ranks_are_the_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 7, 50, 500):
        for k in (1, 2, 4):
            s = rng.integers(1, k + 1, n)
            got = suffix_dedup.suffix_ranks(s)
            if n <= 60:  # shorter than SPAN, so all ranks differ
                order = sorted(range(n), key=lambda i: s[i:].tolist())
                assert np.argsort(got).tolist() == order
            else:
                order = np.argsort(got, kind="stable")
                assert all(s[a:].tolist()[:SPAN] <= s[b:].tolist()[:SPAN] for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("most", [2000, 1])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    texts = corpus()
    rng = random.Random(4)
    alone = "".join(rng.choice("abcdé ") for _ in range(2000))
    rows = [*enumerate(texts), (None, texts[6]), (None, alone), (7, alone[300:1200]), (None, None)]
    df = spark.createDataFrame([(i, t, 1, "k", True) for i, t in rows], "doc_id bigint, text string, print int, kept string, no_id boolean").repartition(5)
    got = sorted(((str(r.doc_id), r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()), key=repr)
    raw = [(t or "").encode() for _, t in rows]
    assert got == sorted(((str(i), len(t), *x) for (i, _), t, x in zip(rows, raw, brute(raw))), key=repr)


def test_repeated_rows_and_empty(spark):
    t = "".join(chr(97 + i * 7 % 26) for i in range(300))
    rows = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, t), (1, t)], "doc_id bigint, text string")).collect()
    assert [bytes(r.kept) for r in rows] == [b"", b""]
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_very_long_text(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = suffix_dedup.suffix_dedup(spark.createDataFrame([(1, long), (2, "!" + long[100_000:100_500] + "?")], "doc_id bigint, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.removed] for r in rows} == {1: [(100_000, 100_500)], 2: [(1, 501)]}


def test_rows_with_one_id_and_text_take_linear_space(spark, monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    tables, stored = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    monkeypatch.setattr(suffix_dedup, "dropped", lambda *t: None)
    df = spark.createDataFrame([(None, text)] * 3000 + [(1, text[:500])], "doc_id bigint, text string").repartition(4)
    out = suffix_dedup.suffix_dedup(df)
    assert out.where("octet_length(kept) = 0").count() == 3001
    assert max(r.n for r in tables["spans"].selectExpr("size(marks) AS n").collect()) < 200
