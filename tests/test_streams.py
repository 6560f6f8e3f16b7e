"""Streams against the same work on whole tables: append logs, the sharded source, guards and packing with typed state."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.store.folder import Folder
from tessera.store.keyed import KeyedTable
from tessera.streaming import guards, source
from tessera.streaming.append import write_back
from tessera.streaming.log import AppendLog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_batch_is_in_the_log_once(spark, tmp_path, monkeypatch):
    log = AppendLog(spark, f"file://{tmp_path}/log")
    batch = [spark.createDataFrame([(10 * k + i,) for i in range(4)], "n int") for k in range(3)]
    assert log.write(batch[0], 0) and not log.write(batch[0], 0)
    commit = Folder.commit
    monkeypatch.setattr(Folder, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        log.write(batch[1], 1)  # written, not committed
    monkeypatch.setattr(Folder, "commit", commit)
    assert [r[0] for r in rows(log.read("n int"))] == [0, 1, 2, 3]
    assert log.write(batch[1], 1) and log.write(batch[2], 2)
    assert sorted(r.n for r in log.read("n int").collect()) == [10 * k + i for k in range(3) for i in range(4)]
    assert log.total() == 12 and log.total(1) == 4 and log.committed() == [0, 1, 2]


def test_resume_stop_and_start_anew(spark, tmp_path):
    at = f"file://{tmp_path}"
    log = AppendLog(spark, f"{at}/log")
    for k in range(3):
        spark.createDataFrame([(10 * k + i,) for i in range(10)], "n int").coalesce(1).write.mode("append").parquet(f"{at}/in")
        log.start(spark.readStream.schema("n int").parquet(f"{at}/in"), f"{at}/state", most=24).awaitTermination()
        assert log.total() == min(24, 10 * (k + 1)) == log.read("n int").distinct().count()
    log.start(spark.readStream.schema("n int").parquet(f"{at}/in"), f"{at}/state", resume=False).awaitTermination()
    assert rows(log.read("n int")) == sorted([(i,) for i in range(30)], key=repr)


def test_the_source_gives_places_over_restarts(spark, tmp_path):
    rng, texts, at = random.Random(1), [], f"file://{tmp_path}"
    for k in range(4):
        part = [(rng.choice(["", None, f"text {k} {i}"]), rng.choice(["", None, f"content {k} {i}"])) for i in range(rng.randint(1, 40))]
        texts += part
        df = spark.createDataFrame(part, "text string, content string").coalesce(1)
        df.write.parquet(f"{at}/staged{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"staged{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k:04d}.parquet")
        if k in (1, 3):  # two files at a time
            stream = source.texts(spark, f"{at}/in", 3)
            AppendLog(spark, f"{at}/out").start(stream, f"{at}/state").awaitTermination()
    want = [(i, i % 3, t or c) for i, (t, c) in enumerate(texts) if t or c]
    assert rows(AppendLog(spark, f"{at}/out").read("place bigint, shard int, text string")) == sorted(want, key=repr)
    AppendLog(spark, f"{at}/one").start(source.texts(spark, f"{at}/in", 3, 1), f"{at}/state1").awaitTermination()
    assert rows(AppendLog(spark, f"{at}/one").read("place bigint, shard int, text string")) == sorted([r for r in want if r[1] == 1], key=repr)


def drained(spark, frames, schema, make, tmp_path):
    at, log = f"file://{tmp_path}", AppendLog(spark, f"file://{tmp_path}/out")
    for part in frames:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        out = make(spark.readStream.schema(schema).parquet(f"{at}/in"))
        log.start(out, f"{at}/state").awaitTermination()
    return rows(log.read(out.schema)), f"{at}/state"


def plain_guards(calls, repeats=4, errors=3):
    out = []
    for run in {r[0] for r in calls}:
        seen, streak = {}, 0
        for _, turn, call, obs, *_ in sorted((r for r in calls if r[0] == run), key=lambda r: r[1]):
            seen[call] = seen.get(call, 0) + 1
            if seen[call] >= repeats:
                out.append((run, turn, "repeat"))
                break
            streak = streak + 1 if (obs or "").startswith("ERROR") else 0
            if streak == errors:
                out.append((run, turn, "errors"))
                streak = 0
    return sorted(out, key=repr)


def test_guards_over_batches(spark, tmp_path):
    rng = random.Random(2)
    calls = [(run, turn, rng.choice("abcdefgh") if run % 2 else f"c{turn}", rng.choice(["ERROR: x", "ERROR", "fine", None])) for run in range(8) for turn in range(20)]
    frames = [[r for r in calls if r[1] // 7 == k] for k in range(3)]
    got, _ = drained(spark, frames, "run bigint, turn bigint, call string, obs string", guards.guards, tmp_path)
    assert got == plain_guards(calls) and {r[2] for r in got} == {"repeat", "errors"}


def test_a_finished_run_leaves_no_state(spark, tmp_path):
    frames = [[(1, 0, "a", "x", False), (2, 0, "b", "x", False)], [(1, 1, "a", "x", True), (2, 1, "c", "x", False)]]
    _, state = drained(spark, frames, "run bigint, turn bigint, call string, obs string, last boolean", guards.guards, tmp_path)
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "calls").load()
    assert {r[0] for r in left.select("key.run").collect()} == {2}
    streak = spark.read.format("statestore").option("path", state).option("stateVarName", "streak").load()
    assert {r[0] for r in streak.select("key.run").collect()} == {2}


def test_packing_over_batches(spark, tmp_path):
    texts = [(i, i % 2, f"text {i} " + "é" * (i % 9)) for i in range(40)]
    frames = [[t for t in texts if t[0] // 15 == k] for k in range(3)]
    got, _ = drained(spark, frames, "place bigint, shard int, text string", lambda s: guards.packed(s, 16), tmp_path)
    for shard in (0, 1):
        whole = "".join(t for _, s, t in texts if s == shard)
        want = [[ord(x) for x in whole[a : a + 17]] for a in range(0, len(whole) - 16, 16)]
        assert [list(r[2]) for r in sorted((r for r in got if r[0] == shard), key=lambda r: r[1])] == want


def test_write_back_numbers_records_over_restarts(spark, tmp_path):
    at, want = f"file://{tmp_path}", {}
    schema = spark.createDataFrame([], "h string, at int, vec_index bigint").schema
    table = KeyedTable.create(spark, f"{at}/t", schema, "h", buckets=4)
    rng = random.Random(3)
    for k in range(3):
        part = [(f"h{rng.randint(0, 30)}", 100 * k + i) for i in range(20)]
        spark.createDataFrame(part, "h string, at int").coalesce(1).write.mode("append").parquet(f"{at}/in")
        write_back(spark.readStream.schema("h string, at int").parquet(f"{at}/in"), table, "at", "vec_index", f"{at}/state").awaitTermination()
        for h, a in part:
            want.setdefault(h, (h, a, len(want)))
        assert rows(table.read()) == sorted(want.values(), key=repr)
