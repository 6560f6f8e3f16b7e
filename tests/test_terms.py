"""Terms counted in tasks, and what is built on them, against plain code."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tessera.operators import memory
from tessera.store import terms

ROWS = [(1, "a b a b"), (1, "b c"), (2, "a_b c"), (3, ""), (4, None), (5, "the a b c"), (6, "the z"), (7, "the z"), (None, "the a"), (None, "q")]


def plain(rows):
    out = defaultdict(Counter)
    for key, text in rows:
        w = (text or "").lower().split()
        out[key].update(w + [f"{a}_{b}" for a, b in zip(w, w[1:])])
    return {k: c for k, c in out.items() if c}


@pytest.mark.parametrize("often", [1, 2, 1000])
def test_topk_by_plain_code_without_stored_postings(spark, monkeypatch, often):
    monkeypatch.setattr(terms, "OFTEN", often)
    monkeypatch.setattr(terms, "SLICE", 5)
    monkeypatch.setattr(memory, "ASKED", 4)
    monkeypatch.setattr(memory, "SCORES", 6)
    names, stored = [], memory.stored
    monkeypatch.setattr(memory, "stored", lambda df, name: names.append(name) or stored(df, name))
    docs = spark.createDataFrame(ROWS, "d int, t string").repartition(3)
    asked = [(10, "the a b"), (11, "a b c"), (12, "nowhere"), (13, "")]
    got = memory.tfidf_topk(docs, spark.createDataFrame(asked, "q int, t string"), "d", "q", "t", 3)
    got = sorted((r.q, r.rank, r.d, round(r.score, 9)) for r in got.collect())
    n, found = len(ROWS), plain(ROWS)
    df = Counter(x for c in found.values() for x in c)
    idf = lambda x, more: math.log((n + 1 + more) / (df[x] + 1 + more)) + 1
    size = {k: math.sqrt(sum((tf * idf(x, 0)) ** 2 for x, tf in c.items())) for k, c in found.items()}
    assert {r.d: round(r.s, 9) for r in terms.sums(docs, "d", "t", memory.idf_of(n)).select("d", F.sqrt("squares").alias("s")).collect()} == {k: round(s, 9) for k, s in size.items()}
    want = []
    for q, text in asked:
        wq = {x: tf * idf(x, 1) for x, tf in plain([(q, text)]).get(q, {}).items() if df[x]}
        nq = math.sqrt(sum(w * w for w in wq.values()))
        scored = [(-round(sum(wq[x] * c[x] * idf(x, 0) for x in wq if x in c) / nq / size[k], 9), k) for k, c in found.items() if k is not None and set(c) & set(wq)]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scored)[:3])]
    assert got == sorted(want)
    assert {(r.term, r.df) for r in terms.seen(docs, "d", "t").collect()} == set(df.items())
    assert "postings" not in names


@pytest.mark.parametrize("words", [["a", "b", "c"], ["a", "b", "a_b", "b_c", "_", ""]])
def test_lists_of_terms(words):
    rng = random.Random(1)
    for _ in range(100):
        rows = [[rng.choice(words) for _ in range(rng.randint(0, 6))] if rng.random() > 0.1 else None for _ in range(rng.randint(0, 6))]
        lists = terms.pa.array([["x"], *rows, ["y", "z"]], terms.pa.list_(terms.pa.string())).slice(1, len(rows))
        found, begin, row, tf = terms.lists_of(lists)
        got = [(int(row[j]), t, int(tf[j])) for i, t in enumerate(found.to_pylist()) for j in range(begin[i], begin[i + 1])]
        want = [(int(r), x, int(n)) for r, c, n, names in [terms.counts(lists, True)] for r, x, n in zip(r, names.take(terms.pa.array(c)).to_pylist(), n)]
        assert sorted(got) == sorted(want) and len(set(found.to_pylist())) == len(found)
