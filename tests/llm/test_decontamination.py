"""Wu-Manber decontamination: against SQL, plain code, small shards, short items, odd tables."""

import hashlib
import random
import re

import duckdb
import pytest
from tessera.llm import wu_manber

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    """What the contract says, window by window."""
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wanted.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    found |= wanted[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    out = wu_manber.decontaminate(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **more)
    return sorted(map(tuple, out.collect()), key=repr)


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = wu_manber.op11_decontamination(spark, SF)
    want = con.execute(wu_manber.OP11_SQL)
    assert [c[0] for c in want.description] == got.columns
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr) and any(r[-1] for r in rows)


@pytest.mark.parametrize("shard_bytes", [1 << 24, 600, 40])
def test_against_plain_code(spark, shard_bytes):
    rng = random.Random(5)
    names = ["a", "b", "Ab", "ñu", "x1", "longerword", "中文", "the", "é", "Z"]
    text = lambda n: "".join(rng.choice(names) + rng.choice([" ", ", ", "\n", " - ", "\x00", "_"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([10, 11, 25, 40, 1, 2, 3, 9, 0])] + [(4, text(12)), (None, text(12)), (77, None), (78, "é" * 400), (79, "...")]
    bits = [t for _, t in items if t]
    docs = [(i, text(rng.randint(0, 60)) + rng.choice(bits)[rng.randint(0, 9) :] + rng.choice([" ", ""]) + rng.choice(bits) + " " + text(rng.randint(0, 9))) for i in range(60)]
    docs += [(1, None), (1, ""), (None, bits[0]), (7, bits[2]), (7, bits[2]), (8, " ".join(bits * 40)), (9, "a")]
    assert run(spark, docs, items, shard_bytes=shard_bytes) == plain(docs, items)


def test_windows_that_share_blocks_and_ends(spark):
    same = "one two three four five six seven eight nine".split()
    items = [(i, " ".join([*same[:4], f"w{i}", *same[4:]])) for i in range(50)] + [(100 + i, " ".join([f"v{i}", *same])) for i in range(50)]
    docs = [(i, f"x {items[i][1]} {items[(i * 7) % 100][1].upper()} y") for i in range(100)] + [(200, " ".join(same)), (201, "x" + items[3][1])]
    assert run(spark, docs, items) == plain(docs, items)


def test_very_long_text_and_hot_passage(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "z " * 200_000 + item + " q" * 100_000 + " " + item)] + [(i, item) for i in range(2, 400)]
    assert run(spark, docs, [(1, item), (2, item)]) == plain(docs, [(1, item), (2, item)])


def test_odd_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == plain([(1, "a b")], [])
    odd = spark.createDataFrame([(1, "a b c", "x", [1], "t")], "doc_id bigint, text string, item string, covered array<int>, items string")
    assert [r[:4] for r in wu_manber.decontaminate(odd, spark.createDataFrame([(1, "B")], ITEMS)).collect()] == [(1, 3, 1, 1)]
