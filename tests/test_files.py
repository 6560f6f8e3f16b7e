import json

import pytest
from tessera.sinks import files as sinks
from tessera.sources import files
from tessera.streaming.append import append_unseen


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "task": "x"}\n\n# note\n{"id": "2"\n{"id": "3"}\n')
    rows = files.json_lines(spark, str(tmp_path), "id string, task string")
    assert {r.id for r in files.lenient(rows).collect()} == {"1", "3"}
    (report,) = files.gate_report(rows, ["id", "task"]).collect()
    assert (report.total, report.failed, report.valid) == (2, 2, 1)
    with pytest.raises(Exception, match="bad row"):
        files.strict(rows, ["id", "task"]).collect()


def test_only_one_json_object_a_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{'id': 'x'}\n{\"id\": \"y\"} )\n{\"id\": \"z\"}\n[1]\n  {\"id\": \"w\"}  \n")
    rows = files.json_lines(spark, str(tmp_path), "id string")
    assert {r.id for r in files.lenient(rows).collect()} == {"z", "w"}


def test_strict_stops_every_reader_and_names_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "prompt": "x"}\n\n{"id": "2", "task": "y"}\n{"id": "3"}\n')
    rows = files.strict(files.parse_lines(files.numbered_lines(spark, str(tmp_path)), "id string, prompt string, task string"), ["id", "prompt|task"])
    for read in (lambda: rows.collect(), lambda: rows.count(), lambda: rows.select("id").collect(), lambda: rows.select("number").collect()):
        with pytest.raises(Exception, match="bad row in a.jsonl:4: no prompt"):
            read()


def test_gate(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n# note\n')
    read = lambda: files.json_lines(spark, str(tmp_path), "id string")
    assert [r.id for r in files.gated(read(), ["id"]).collect()] == ["1"]
    (tmp_path / "b.jsonl").write_text('{"id": ""}\n{\n')
    with pytest.raises(ValueError, match="ABORT: 2 record"):
        files.gated(read(), ["id"])
    (tmp_path / "a.jsonl").write_text("# only a note\n")
    (tmp_path / "b.jsonl").write_text("")
    with pytest.raises(ValueError, match="no valid"):
        files.gated(read(), ["id"])


def test_listing_and_fallback(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("b.txt", "a.txt", "d/c.txt"):
        (tmp_path / name).write_text("xy")
    (tmp_path / "empty").write_text("")
    found = files.listing(spark, str(tmp_path), 2).collect()
    assert [r.path.split("/")[-1] for r in found] == ["a.txt", "b.txt"] and found[0]["size"] == 2
    assert files.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "empty"), str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]) == str(tmp_path / "b.txt")
    assert files.first_existing(spark, [str(tmp_path / "none")]) is None


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,t\n1,0.5,a\n2,1.5,b\n")
    assert [tuple(r) for r in files.csv_typed(spark, str(tmp_path / "a.csv")).collect()] == [(1, 0.5, "a"), (2, 1.5, "b")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.csv_typed(spark, str(tmp_path / "none.csv"))


def test_csv_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,passed,transcript\n1,True,"two\nlines, ""quoted"""\n2,,x\n')
    rows = sorted(tuple(r) for r in files.csv_text(spark, str(tmp_path / "a.csv"), ["id", "passed", "transcript"]).collect())
    assert rows == [("1", "True", 'two\nlines, "quoted"'), ("2", "", "x")]


def test_append_unseen(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", 1), ("a", 2), ("b", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(part, "h string, n int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("h string, n int").parquet(source)
        append_unseen(stream, "h", target, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.h for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_paths_stay_below_their_root(spark, tmp_path):
    root = str(tmp_path / "repo")
    (tmp_path / "repo" / "a").mkdir(parents=True)
    (tmp_path / "repo" / "a" / "x.txt").write_text("x")
    (tmp_path / "repository").mkdir()
    assert files.below("/r", "a/../b") == "/r/b" and files.below("/r", "/r/b") == "/r/b" and files.below("/r", ".") == "/r"
    for bad in ("..", "../repository", "a/../../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            files.below(root, bad)
    assert [r.path.rsplit("/", 1)[1] for r in files.listing_below(spark, f"file://{root}", "a").collect()] == ["x.txt"]
    assert files.existing(spark, [f"{root}/none", f"{root}/a"]) == [f"{root}/a"]
    with pytest.raises(FileNotFoundError):
        files.existing(spark, [f"{root}/none"], required=True)


def test_predictions(spark, tmp_path):
    sinks.write_predictions(spark.createDataFrame([("i-1", "diff é"), ("i-2", None)], "id string, p string"), str(tmp_path / "p"), "id", "p", "m")
    rows = sorted(json.loads(r.value)["model_patch"] for r in spark.read.text(str(tmp_path / "p")).collect())
    assert rows == ["", "diff é"]
