"""Keyed tables: versions, upserts that touch their buckets only, numbered appends, replays, failures in between."""

import random

import numpy as np
import pytest
from tessera.store import keyed
from tessera.store.folder import Conflict, Folder
from tessera.store.keyed import KeyedTable, bloom, known

SCHEMA = "key string, at int, value string"


def make(spark, tmp_path, **more):
    schema = spark.createDataFrame([], SCHEMA if "schema" not in more else more.pop("schema")).schema
    return KeyedTable.create(spark, f"file://{tmp_path}/t", schema, "key", **{"buckets": 8} | more)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_against_a_dict(spark, tmp_path):
    rng, table, want = random.Random(1), make(spark, tmp_path), {}
    for n in range(4):
        batch = [(rng.choice(["a", "b", "c", None, f"k{rng.randint(0, 60)}"]), i + 100 * n, f"v{n}-{i}") for i in range(30)]
        assert table.upsert(spark.createDataFrame(batch, SCHEMA), "at") == n + 1
        for k, at, v in batch:
            want[k] = (k, at, v)
        assert rows(table.read()) == sorted(want.values(), key=repr)
        assert table.manifest()["rows"] == len(want)
    assert table.upsert(spark.createDataFrame([], SCHEMA), "at") == 4
    assert table.read(1).count() == len({k for k, *_ in rows(table.read(1))}) <= 30


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = make(spark, tmp_path)
    table.upsert(spark.createDataFrame([(f"k{i}", 0, "x") for i in range(200)], SCHEMA), "at")
    before = table.manifest()["data"]
    table.upsert(spark.createDataFrame([("k1", 1, "y")], SCHEMA), "at")
    after = table.manifest()["data"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert [r[2] for r in rows(table.read()) if r[0] == "k1"] == ["y"] and table.read().count() == 200


def test_a_failure_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = make(spark, tmp_path)
    table.upsert(spark.createDataFrame([("a", 0, "old")], SCHEMA), "at")
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([("a", 1, "new"), ("b", 1, "new")], SCHEMA), "at")
    monkeypatch.undo()
    assert rows(table.read()) == [("a", 0, "old")]
    assert table.vacuum() == 2  # what the lost upsert wrote
    assert rows(table.read()) == [("a", 0, "old")]


def test_the_second_writer_of_a_version_fails(spark, tmp_path):
    table = make(spark, tmp_path)
    m = table.manifest()
    table.upsert(spark.createDataFrame([("a", 0, "x")], SCHEMA), "at")
    with pytest.raises(Conflict):
        table._commit(m)
    assert rows(table.read()) == [("a", 0, "x")]
    assert not [n for n in Folder(spark, f"file://{tmp_path}/t").names("versions") if n.endswith(".tmp")]


def test_appends_are_numbered_and_come_once(spark, tmp_path):
    table = make(spark, tmp_path, schema="key string, at int, value string, place bigint")
    rng, want = random.Random(2), {}
    for n in range(5):
        batch = [(f"k{rng.randint(0, 90)}" if i else None, i + 100 * n, f"v{i}") for i in range(40)]
        for again in (False, True):
            out = table.append(spark.createDataFrame(batch, SCHEMA), "at", "place", ("s", n))
            assert out["again"] is again
        for k, at, v in sorted(batch, key=lambda r: r[1]):
            want.setdefault(k, (k, at, v, len(want)))
        assert rows(table.read()) == sorted(want.values(), key=repr)


def test_a_batch_of_new_keys_reads_no_buckets_and_growth_adds_buckets(spark, tmp_path):
    table = make(spark, tmp_path, buckets=2, bucket_rows=100)
    read = []
    for n in range(4):
        out = table.append(spark.createDataFrame([(f"{n}-{i}", i, "x") for i in range(300)], SCHEMA), "at")
        read.append(out["read"] / out["asked"])
        assert out["added"] == 300
    assert table.manifest()["buckets"] == 16
    one = table.append(spark.createDataFrame([("0-7", 0, "x"), ("new", 0, "x")], SCHEMA), "at")
    assert one["added"] == 1 and one["asked"] <= 2 and one["read"] >= 1
    assert table.read().count() == 1201 == table.manifest()["rows"]


def test_many_small_appends_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_FOLDERS", 2)
    table = make(spark, tmp_path, buckets=1)
    for n in range(4):
        table.append(spark.createDataFrame([(f"{n}", n, "x")], SCHEMA), "at")
    assert len(table.manifest()["data"]["0"]) <= 2 and table.read().count() == 4


def test_blooms():
    h = np.random.default_rng(0).integers(-(2**63), 2**63, 5000)
    f = bloom(h)
    assert known(f, h).all() and known(f, h + 1).mean() < 0.03 and not known(bloom(h[:0]), h).any()
