"""Stateful streams against the same work done at once; sinks read back."""

import json

from pyspark.sql import functions as F
from tessera.sinks import files as sinks
from tessera.sources.files import csv_text
from tessera.streaming import stateful


def drained(spark, frames, schema, make, name, tmp_path):
    """The rows that a stream gives whose files arrive one after another, over restarts of the query."""
    source, target, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).collect()


def test_packing_carries_the_rest_on(spark, tmp_path):
    texts = [f"text number {i} " + "é" * (i % 7) for i in range(30)] + [""]
    frames = [[(i, t, None) for i, t in enumerate(texts) if i // 11 == k] for k in range(3)]
    frames[2].append((40, None, "from content " * 3))
    got = drained(spark, frames, "place int, text string, content string", lambda s: stateful.pack_stream(stateful.sharded(s, 2), 16), "pack", tmp_path)
    for shard in (0, 1):
        whole = "".join(t or c or "" for k in range(3) for i, t, c in frames[k] if i % 2 == shard)
        want = [[ord(x) for x in whole[at : at + 17]] for at in range(0, len(whole) - 16, 16)]
        assert [list(r.ids) for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.chunk)] == want


def test_guards(spark, tmp_path):
    rows = [(1, t, "a" if t in (0, 2, 4, 6, 8) else f"b{t}", "ok") for t in range(9)]
    rows += [(2, t, f"c{t}", "ERROR: x" if t != 3 else "fine") for t in range(11)]
    frames = [[r for r in rows if r[1] // 4 == k] for k in range(3)]
    got = drained(spark, frames, "run bigint, turn bigint, call string, obs string", stateful.guard_stream, "guard", tmp_path)
    assert sorted(tuple(r) for r in got) == [(1, 6, "repeat"), (2, 2, "errors"), (2, 6, "errors"), (2, 9, "errors")]


def test_a_stream_stops_after_so_many_rows(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(10 * k + i,) for i in range(10)], "n int").write.mode("append").parquet(source)
        stateful.first_rows(spark.readStream.schema("n int").parquet(source), 14, target, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(target).count() == 14


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'é "q"\nline', None, "a"), ("2", "", 3, "b"), ("3", "x", 4, "b")], "id string, t string, n int, route string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(lines, key=lambda x: x["id"])[0] == {"id": "1", "t": 'é "q"\nline', "n": None, "route": "a"}
    assert "é" in "".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    sinks.write_csv(df, str(tmp_path / "c"), "run", "now")
    back = csv_text(spark, str(tmp_path / "c"), ["id", "t", "n", "route", "run_label", "timestamp"])
    assert sorted(tuple(r) for r in back.collect()) == [("1", 'é "q"\nline', "", "a", "run", "now"), ("2", "", "3", "b", "run", "now"), ("3", "x", "4", "b", "run", "now")]
    sinks.write_by_route(df, "route", str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"route=a", "route=b"}
    assert spark.read.json(str(tmp_path / "r" / "route=b")).count() == 2
    assert sinks.manifest(df, "route") == {"total": 3, "keys": 2, "by_key": {"a": 1, "b": 2}}
    sinks.write_report(spark, {"a": 1}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"a": 1}
    sinks.write_failure_analysis({"x": df.withColumn("n_errors", F.lit(1))}, str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), header=True).count() == 3
    assert [r.line for r in sinks.console_table(df.where("id = '3'"), {"id": 3, "n": 4}).collect()] == ["3       4"]
