"""Runs by Lyndon arrays: against all periods tried in turn, on repetitive words, odd tables."""

import hashlib
import random
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import lyndon_runs
from tessera.llm.lyndon_runs import collapsed, edges, runs, tandem

SF = "/root/testdata/sf0.001"


def brute(t, exponent=2, least=2):
    out = set()
    for p in range(1, len(t) // 2 + 1):
        i = 0
        while i + p < len(t):
            if t[i] != t[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(t) and t[i] == t[i + p]:
                i += 1
            w = t[s : i + p]
            if len(w) >= max(least, exponent * p) and not any(w[q:] == w[:-q] for q in range(1, p)):
                out.add((s, len(w), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=70) | st.lists(st.sampled_from("abc"), max_size=50) | st.builds(lambda x, n, y: x * n + y, st.lists(st.sampled_from("abcd"), max_size=8), st.integers(0, 9), st.lists(st.sampled_from("abcd"), max_size=9)))
def test_all_runs(t):
    assert runs(t) == brute(t)
    assert runs(t, 4, 6) == brute(t, 4, 6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.booleans())
def test_edges_are_the_next_smaller_suffixes(t, up):
    code = ["abc".index(x) * (1 if up else -1) for x in t]
    want = []
    for i in range(len(t)):
        j = next((j for j in range(i + 1, len(t)) if code[j:] < code[i:]), None)
        if j is not None:
            e = 0
            while j + e < len(t) and t[i + e] == t[j + e]:
                e += 1
            if e:
                want.append((i, j, e))
    assert sorted(edges(t, up)) == want


class Counted(str):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return str.__eq__(self, other)

    __hash__ = str.__hash__


def test_comparisons_grow_with_the_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 8000:
        a, b = b, b + a
    for text in (b[:8000], ["a"] * 8000, ["a", "b"] * 4000, (["a"] * 89 + ["b"]) * 90, ["ab"[bin(i).count("1") % 2] for i in range(8000)], (b[:700] * 12)[:8000]):
        Counted.compared = 0
        for up in (True, False):
            edges([Counted(x) for x in text], up)
        assert Counted.compared <= 6 * len(text)


def test_overlapping_runs_collapse():
    w = list("abababababab") + list("cccccccc") + list("abcabcabcabcabcx")
    found = runs(w, 4, 6)
    assert found == brute(w, 4, 6)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    assert collapsed(w, found) == [x for i, x in enumerate(w) if i not in gone]


def plain_row(key, text):
    w = (text or "").encode().split()
    if key is not None:
        h = zlib.crc32(str(key).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w, 4, 6)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return key, len(found), s, n, q, 1000 * n // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_query_against_all_periods(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 9000")
    want = sorted((plain_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = {r.doc_id: tuple(r) for r in lyndon_runs.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == 200 and sum(r[1] > 0 for r in want) > 10
    assert sorted((got[r[0]] for r in want), key=repr) == want


def test_tandem_leaves_other_keys_alone():
    assert tandem(["a", "b"], 11) == ["a", "b"] and tandem([], 10) == []


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, id string, n_runs int, words string"
    assert lyndon_runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a " * 9, "x", 1, ""), (1, None, None, None, None), (1, None, None, None, None), (2, "", "", 0, ""), (3, "a\tb\na\x0bb\x0ca\rb a b", "", 0, ""), (4, "x " * 100_000, "", 0, "")]
    out = [tuple(r)[:6] for r in lyndon_runs.periodic_runs(spark.createDataFrame(rows, schema)).collect()]
    none = (0, None, None, None, None)
    assert sorted(out, key=repr) == sorted([(None, 1, 0, 9, 1, 9000), (1, *none), (1, *none), (2, *none), (3, 1, 0, 8, 2, 4000), (4, 1, 0, 100_000, 1, 100_000_000)], key=repr)


def test_long_text_is_quick():
    a, b = ["a"], ["a", "b"]
    while len(b) < 200_000:
        a, b = b, b + a
    began = time.time()
    assert len(runs(b, 2, 2)) > 100_000
    assert time.time() - began < 30
