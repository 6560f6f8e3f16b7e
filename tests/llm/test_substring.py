"""Substring dedup against a plain version, and on planted passages."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from tessera.llm import substring_dedup

WHITE = " \t\n\x0b\x0c\r"


def own_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def units(text):
    """(start, end, end with the white space after it) of each unit, character by character."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] != "\n" and not (text[end] in ".!?" and end + 1 < len(text) and text[end + 1] in WHITE):
            end += 1
        stop = end
        if end < len(text) and text[end] == "\n":
            stop = end + 1
        elif end < len(text):
            end = stop = end + 1
            while stop < len(text) and text[stop] in WHITE:
                stop += 1
        out.append((at, end, stop))
        at = stop
    return out


def plain(rows, least_words=substring_dedup.LEAST_WORDS, least_run=substring_dedup.LEAST_RUN):
    """The text that stays of each of rows (id, text), which are in rank order."""
    seen, out = set(), []
    for _, text in rows:
        if text is None:
            out.append((None, []))
            continue
        run, words, gone = [], 0, []
        for start, end, stop in [*units(text), (None, None, None)]:
            unit = [] if start is None else [w for w in re.split(r"[\x20\x09-\x0D]+", text[start:stop].lower()) if w]
            key = " ".join(unit)
            if len(unit) >= least_words and key in seen:
                run, words = [*run, (start, end, stop)], words + len(unit)
                continue
            if words >= least_run:
                gone += run
            run, words = [], 0
            if len(unit) >= least_words:
                seen.add(key)
        kept, at = [], 0
        for start, _, stop in gone:
            kept.append(text[at:start])
            at = stop
        out.append(("".join([*kept, text[at:]]), [(a, b) for a, b, _ in gone]))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], "doc_id bigint, text string, n_removed int, row string, gone string").repartition(3)
    return substring_dedup.substring_dedup(df, **more).collect()


def test_against_a_plain_version(spark):
    rng = random.Random(8)
    shared = [". ".join(own_words(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 6))) + "." for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [own_words(rng, rng.randint(0, 20)) + rng.choice(["", ".", "!", " 3.14 ", "?!"]) for _ in range(rng.randint(0, 5))]
        parts += rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i, "".join(p + rng.choice([" ", "\n", "\n\n", " \t", " \n "]) for p in parts)))
    rows += [(60, None), (61, ""), (62, " \n"), (63, rows[7][1]), (64, "é " * 40 + ". " + shared[0])]
    got = {r.doc_id: (r.text, [tuple(s) for s in r.removed]) for r in run(spark, rows)}
    assert got == {i: x for (i, _), x in zip(rows, plain(rows))}
    assert sum(bool(s) for _, s in got.values()) > 10


def test_a_passage_inside_a_line_goes(spark):
    rng = random.Random(9)
    sentences = [own_words(rng, 12).capitalize() + "." for _ in range(5)]
    passage = " ".join(sentences)
    rows = [(i, f"{own_words(rng, 30)} {passage} {own_words(rng, 30)}") for i in range(4)]
    out = {r.doc_id: r for r in run(spark, rows)}
    assert out[0].text == rows[0][1]
    for i in (1, 2, 3):
        assert out[i].n_removed == 4 and not any(s in out[i].text for s in sentences[1:])
        assert "".join(rows[i][1][s.start : s.end] for s in out[i].removed) == "".join(sentences[1:])


def test_short_stock_lines_stay(spark):
    rng = random.Random(10)
    stock = "all rights of this work are with those who wrote it"
    rows = [(i, f"{own_words(rng, 40)}\n{stock}\n{own_words(rng, 40)}") for i in range(30)]
    assert all(r.n_removed == 0 and r.text == dict(rows)[r.doc_id] for r in run(spark, rows))


@pytest.mark.parametrize("same", [1, None])
def test_rows_that_share_an_id_are_told_apart(spark, same):
    rng = random.Random(11)
    line = own_words(rng, 25)
    rows = [(0, f"{line}\nfirst"), (same, f"{line}\nsecond"), (same, f"an entirely other line of this text that stands nowhere else\n{line}")]
    assert sorted(r.text for r in run(spark, rows)) == sorted([rows[0][1], "second", "an entirely other line of this text that stands nowhere else\n"])


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(12)
    long = "\n".join(own_words(rng, 25) for _ in range(2000))
    rows = [(1, long), (1, long), (2, "word " * 20000), (3, f"z\n{long}")]
    out = sorted((r.doc_id, len(r.text)) for r in run(spark, rows))
    assert out == [(1, 0), (1, len(long)), (2, 100000), (3, 2)]


def test_pieces_are_the_same_for_spark_and_python(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab.!?\n\t \x0b\r\u00e9\u2028") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", substring_dedup.pieces(F.col("t")).alias("p"))
    for r in df.collect():
        assert [x for x in substring_dedup._PIECE.findall(r.t) if x] == list(r.p)


def test_two_hundred_thousand_lines(spark):
    rng = random.Random(13)
    lines = [own_words(rng, 6) for _ in range(2000)]
    text = "\n".join(f"{i} {lines[i % 2000]}" for i in range(200_000))
    began = time.time()
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id bigint, text string")).collect()}
    assert out[1].text == text and out[2].text == "end" and out[2].n_removed == 200_000
    assert time.time() - began < 60
