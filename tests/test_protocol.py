"""Scanners and rules of transcripts against plain code and hand-made cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.functions import protocol as P
from tessera.functions import scanners as S
from tessera.operators import ingest, training
from tessera.operators.protocol import extract_records, failure_analysis, score_rows

CALL = 'TOOL_CALL: execute_code({"code": "assert f(1)\\nprint(\'PASS\')"})'


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def closes(text, at, pair):
    """Where the bracket that opens at or after at closes, one character after another."""
    depth, quote, skip = 0, "", False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == pair[0]:
            depth += 1
        elif c == pair[1]:
            depth -= 1
            if depth == 0:
                return i + 1
    return -1


@pytest.mark.parametrize("pair", ["{}", "()"])
def test_brackets_against_single_steps(pair):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("{}()\"'\\ab") for _ in range(rng.randint(0, 14)))
        assert S.bracket_end(text, 0, pair) == closes(text, 0, pair), text


def test_code_bodies():
    nested = json.dumps({"code": "d = {'a': {1}}\nprint(\"}\")"})
    text = f"x execute_code({nested}) execute_code({{'code': 'x'}}) execute_code({{\"kode\": 1}}) execute_code({{\"code\": \"open"
    assert S.code_bodies(text) == [json.loads(nested)["code"], None]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("no call", (-1, "", -1)),
        ("TOOL_CALL:", (0, "", -1)),
        ("TOOL_CALL: f", (0, "", -1)),
        ('TOOL_CALL: f({"x": "(1 + 2"}', (0, "", -1)),
        ('a TOOL_CALL:\n f ({"x": "(1 + 2"}) b', (2, 'f ({"x": "(1 + 2"})', 33)),
        ("TOOL_CALL: f(g('OBSERVATION: )'))", (0, "f(g('OBSERVATION: )'))", 33)),
    ],
)
def test_pending_call(text, found):
    assert S.pending_call(text, -1) == found


def test_a_call_split_over_two_chunks():
    whole = f"{CALL}\nOBSERVATION: ok\nTOOL_CALL: g(1)"
    first = S.pending_call(whole, -1)
    assert first[1] == CALL[11:] and S.pending_call(whole, first[0])[1] == "g(1)" and S.pending_call(CALL[:30], -1)[1] == ""


@pytest.mark.parametrize(
    ("call", "kind"),
    [("f", "unparsable"), ("g({})", "unknown"), ('f({"a": 1})', "ok"), ("f({'a': 1}) ", "fixed_quotes"), ("f({'a': \"it's\"})", "invalid_json"), ('f({"a": 1} )', "ok"), ("f({a)", "invalid_json")],
)
def test_dispatch(call, kind):
    assert S.dispatch_class(call, frozenset(["f"])) == kind


@pytest.mark.parametrize(
    ("text", "call"),
    [
        (f"{CALL}\nOBSERVATION: PASS", CALL),
        (f"TOOL_CALL: execute_code({{\"code\": \"x\"}})\n{CALL}\nOBSERVATION: PASS\nTOOL_CALL: execute_code({{\"code\": \"late\"}})", CALL),
        (f"OBSERVATION: PASS\n{CALL}", None),
        ("TOOL_CALL: execute_code(x)\nOBSERVATION: PASS", None),
        ("TOOL_CALL: execute_code({'code': 1})\nOBSERVATION: PASS", None),
        (CALL, None),
    ],
)
def test_passing_call(text, call):
    assert S.passing_call(text) == call


def test_last_resort_of_code_extraction():
    text = "So:\nimport os\n  x\n\n# note\nprint(1)\nprose\nTOOL_CALL: f()\ndef f():\n    pass"
    assert S.statement_lines(text) == "import os\n  x\n\n# note\nprint(1)\ndef f():\n    pass"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("```python\na\n```\nFIXED:\n```python\nb\n```\nFINAL_ANSWER: done", "b"),
        ("```python\na\n```\nFINAL_ANSWER:\n```python\nc\n```", "c"),
        ("```PYTHON a```\n``` g ```", "a"),
        ("x\n``` g ```\nFIXED: ``` h ```", "h"),
        ("RUN_CODE: print(1)\nCRITIQUE: x", "print(1)"),
        ("OBSERVATION: ```python no```\nTOOL_CALL: f()\nprint(2)", "print(2)"),
        ("", ""),
    ],
)
def test_extract_code(spark, text, code):
    assert one(spark, text, lambda t: P.extract_code(t, S.columns()["statement_lines"])) == code


def test_runtime_blocks_go(spark):
    text = "a\nOBSERVATION: x\ny\nCRITIQUE: c [SYSTEM HINT: no] \n[DEBUG] z\nRUNTIME-INJECTED q\nend"
    assert one(spark, text, P.strip_runtime) == "a\nCRITIQUE: c  \n\n\nend"


def plain_segments(text):
    out, at = [], 0
    for m in re.finditer(r"\nOBSERVATION:.*?(?=\n(?:<think>|TOOL_CALL:|CRITIQUE:|FINAL_ANSWER:)|\Z)", text, re.S):
        out += [(text[at : m.start()], True)] * (m.start() > at) + [(m.group(), False)]
        at = m.end()
    return out + [(text[at:], True)] * (at < len(text)) or [(text, True)]


LINES = ["OBSERVATION: PASS", "OBSERVATION: ERROR: ValueError: x", "OBSERVATION: (no output)", CALL, "TOOL_CALL: g(1)", "CRITIQUE: → Solution OK.", "CRITIQUE: fix needed", "FINAL_ANSWER: y", "<think>", "prose", ""]


def plain_flags(text):
    """(approval after a failed observation, the same call again after one), event by event."""
    events = []
    for m in re.finditer(r"OBSERVATION:\s*(.*?)(?=\nTOOL_CALL:|\nCRITIQUE:|\nFINAL_ANSWER:|\Z)", text, re.S):
        obs = m.group(1).strip()
        events.append((m.start(), False if obs.startswith("PASS") else True if "error" in obs.lower() and ("Error" in obs or "ERROR" in obs) else None))
    events += [(m.start(), "ok") for m in re.finditer("→ Solution OK", text, re.I)]
    failed = approves = False
    for _, e in sorted(events, key=lambda e: e[0]):
        if e == "ok":
            approves = approves or failed
        elif e is not None:
            failed = e
    last, failed, inside, again = None, False, False, False
    for line in text.split("\n"):
        if line.startswith("TOOL_CALL:") and len(line) > 10:
            again = again or failed and line.strip() == last
            last, failed, inside = line.strip(), False, False
        elif line.startswith(("CRITIQUE:", "FINAL_ANSWER:", "TOOL_CALL:")):
            inside = False
        elif inside or line.startswith("OBSERVATION:"):
            failed = ("Error" in line or "ERROR" in line) or inside and failed
            inside = True
    return approves, again


def test_transcript_rules_against_plain_code(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", P.segments(F.col("t")).alias("s"), P.approves_after_error(F.col("t")).alias("a"), P.repeats_call_after_error(F.col("t")).alias("r"), P.strip_observations(F.col("t")).alias("o"), P.first_line_type(F.col("t")).alias("k")
    )
    flags = []
    for r in rows.collect():
        text = texts[r.i]
        assert [(s.text, s.supervised) for s in r.s] == plain_segments(text)
        assert r.o == "".join(t for t, own in plain_segments(text) if own)
        assert (r.a, r.r) == plain_flags(text), text
        flags.append((r.a, r.r))
        first = next((x.strip() for x in text.split("\n") if x.strip()), "")
        assert r.k == next((k for k in ("TOOL_CALL", "CRITIQUE", "FINAL_ANSWER") if first.startswith(k + ":")), "other")
    assert sum(a for a, _ in flags) > 10 and sum(b for _, b in flags) > 3


@pytest.mark.parametrize(
    ("text", "issues"),
    [
        (f"{CALL}\nOBSERVATION: PASS\nFINAL_ANSWER: ok", []),
        ("TOOL_CALL: nope(1)", ["unknown tool 'nope'"]),
        ('TOOL_CALL: execute_code({"code": "x = 1"})\nOBSERVATION: PASS', ["successful_execute_code_no_print_pass", "successful_execute_code_no_assert"]),
        ("TOOL_CALL: execute_code({'code': 1})", ["invalid_json_in_execute_code"]),
        ("TOOL_CALL: execute_code({'code': 1})\nOBSERVATION: ERROR: invalid JSON", []),
        ('TOOL_CALL: execute_code({"code": "a\\\\nb"})', ["double_escaped_newline_in_execute_code", "unparseable_python_in_last_execute_code"]),
        ('TOOL_CALL: execute_code({"code": "def f(:"})\nOBSERVATION: ERROR: x', []),
        ("FINAL_ANSWER: x", ["final_answer_without_pass"]),
        ("FINAL_ANSWER: x\nOBSERVATION: PASS", ["final_answer_before_pass"]),
        (f"{CALL}\nOBSERVATION: PASS\nTOOL_CALL: run_tests(1)", ["tool_call_after_pass"]),
        ("CRITIQUE: VALID: ```x```", ["bad_marker VALID:", "bad_marker ```", "recovery_response_never_reaches_pass"]),
        ("OBSERVATION: ERROR\nCRITIQUE: → solution ok\nOBSERVATION: PASS", ["solution_ok_after_error_before_pass"]),
        ("TOOL_CALL: run_tests(1)\nOBSERVATION: Error\nTOOL_CALL: run_tests(1)", ["repeated_identical_tool_call_after_error"]),
    ],
)
def test_audit(spark, text, issues):
    assert one(spark, text, lambda t: P.response_issues(t, S.columns()["audit_codes"](t))) == issues


def test_pass_discipline():
    assert S.pass_discipline('TOOL_CALL: execute_code({"code": "x"})\nOBSERVATION: PASS') == (1, 1, 0)
    assert S.pass_discipline(f"{CALL}\nOBSERVATION: PASS") == (0, 0, 0)
    assert S.pass_discipline(f"{CALL}\nFINAL_ANSWER: x\nOBSERVATION: PASS") == (0, 0, 1)
    assert S.pass_discipline("FINAL_ANSWER: x") == (0, 0, 0)
    assert S.quality('execute_code({"code": "def f(:"}) execute_code({"code": "1"}) execute_code({x})') == (2, 1, 0)


def record(**changes):
    good = {"id": "1", "task": "t", "category": "c", "query_text": "q", "corrected_tool_call": CALL, "observation": "PASS", "verified": True, "created_at": "d", "content_hash": "h", "final_answer": ""}
    return good | changes


@pytest.mark.parametrize(
    ("changes", "errors"),
    [
        ({}, []),
        *[({f: None}, [f"missing required field: '{f}'"]) for f in ("id", "task", "category", "query_text", "created_at", "content_hash")],
        ({"verified": False}, ["verified must be True"]),
        ({"observation": "FAIL"}, ["observation must contain 'PASS'"]),
        ({"corrected_tool_call": "execute_code({})"}, ["corrected_tool_call must start with 'TOOL_CALL: execute_code('"]),
        ({"corrected_tool_call": f" {CALL}\n"}, []),
        ({"corrected_tool_call": CALL[:-1]}, ["corrected_tool_call: unmatched parenthesis"]),
        ({"corrected_tool_call": "TOOL_CALL: execute_code({'code': 1})"}, ["corrected_tool_call: invalid JSON in args"]),
        ({"corrected_tool_call": 'TOOL_CALL: execute_code({"code": 1} x)'}, ["corrected_tool_call: invalid JSON in args"]),
        ({"corrected_tool_call": 'TOOL_CALL: execute_code({"kode": 1})'}, ["corrected_tool_call: args missing 'code' key"]),
        ({"final_answer": "``` VALID: \"\"\""}, ["final_answer: markdown code fences (```) not allowed", "final_answer: banned marker 'VALID:'", "final_answer: banned marker '\"\"\"'"]),
    ],
)
def test_record_errors(spark, changes, errors):
    rec = record(**changes)
    df = spark.createDataFrame([tuple(rec.values())], ", ".join(f"{k} {'boolean' if k == 'verified' else 'string'}" for k in rec))
    assert df.select(P.record_errors(F.col, S.columns()["argument_state"]("corrected_tool_call")).alias("e")).first().e == errors


def test_pollution_guard(spark):
    assert one(spark, "fine", P.guarded) == "fine"
    with pytest.raises(Exception, match="prompt marker"):
        one(spark, "x <|im_start|>user y", P.guarded)


def test_records_from_evaluations(spark):
    from tessera.plans.transcripts import EVAL_ROWS  # noqa: F401  the columns are those of the queries' rows

    names = "doc_id path id category passed passed_via_tool used_fallback_extraction scoring_mode full_transcript has_invalid_json no_output_count has_indentation_error first_exception_type n_errors".split()
    base = ["c", "True", "True", "False", "verified_agent", f"{CALL}\nOBSERVATION: PASS\nFINAL_ANSWER: ok", "False", "0", "False", "", "0"]
    row = lambda n, path, task, **x: [n, path, task, *[x.get(k, v) for k, v in zip(names[3:], base)]]
    rows = [row(1, "b/best_of_3.csv", "t1"), row(2, "z/single.csv", "t1"), row(3, "a/single.csv", "fizzbuzz"), row(4, "a/single.csv", "t2", passed="true"), row(5, "a/single.csv", "t3", full_transcript=f"{CALL}"), row(6, "a/single.csv", "t4", n_errors="2"), row(7, "a/single.csv", "t5", full_transcript='TOOL_CALL: execute_code({"code": "VALID:"})\nOBSERVATION: PASS')]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'doc_id' else 'string'}" for n in names))
    out = [(r.doc_id, r.memory) for r in extract_records(df).collect()]
    assert out == [(3, "task_specific_success"), (6, "assertion_error_to_correct_assert"), (2, "verified_success")]
    assert [r.doc_id for r in extract_records(df, 1).collect()] == [3]


def runs(spark, rows):
    return spark.createDataFrame(rows, "conv_id int, transcript string, tool_calls array<struct<call:string,obs:string>>, critique string, steps int, fallback_obs array<string>")


def test_scores(spark):
    code = 'execute_code({"code": "x = 1"})'
    rows = [
        (0, "", [], "", 1, None),
        (1, "TOOL_CALL: g(1)", [("g(1)", "ERROR: unknown tool 'g'")], "", 1, None),
        (2, "", [(code, "ERROR: IndentationError: a"), (code, "ERROR: IndentationError: a"), (CALL[11:], "PASS"), (code, "3")], "→ Solution OK", 4, None),
        (3, "", [(code, "ERROR: AssertionError: a")], "CRITIQUE: → solution ok; fix needed", 2, None),
        (4, "", [(code, "(no output)")], "", 2, ["PASS"]),
    ]
    by = {r.conv_id: r for r in score_rows(runs(spark, rows)).collect()}
    assert [by[i].failure_reason for i in range(5)] == ["no_tool_call", "unknown_tool", "", "solution_ok_after_error", "tool_call_no_pass"]
    two = by[2]
    assert (two.passed, two.n_errors, two.repeated_same_error_count, two.pass_after_indent_fix, two.unnecessary_retry_after_pass, two.recovered_after_error) == (True, 2, 1, True, True, True)
    assert (two.no_assert_count, two.no_pass_print_count, two.first_exception_type, two.first_call_passed) == (3, 1, "IndentationError", False)
    assert by[1].has_direct_task_tool_call and by[3].has_solution_ok_after_error and by[4].no_output_count == 1
    fallback = {r.conv_id: r for r in score_rows(runs(spark, rows), "answer_quality").collect()}
    assert fallback[4].passed and fallback[4].passed_via_fallback and not by[4].passed and fallback[3].failure_reason == "no_extracted_code"


def test_failure_analysis(spark):
    a = spark.createDataFrame([("1", 2)], "id string, n_errors int")
    b = spark.createDataFrame([("2", True)], "id string, passed boolean")
    out = failure_analysis({"x": a, "y": b})
    assert out.columns == ["id", "category", "mode", "passed", *out.columns[4:]] and len(out.columns) == 17
    assert sorted((r.id, r["mode"], r.passed, r.n_errors, r.category) for r in out.collect()) == [("1", "x", "", "2", ""), ("2", "y", "true", "", "")]


@pytest.mark.parametrize("bug", sorted(training.INJECTORS) + ["off by one"])
def test_bugs(spark, bug):
    code = "def f(xs):\n    total = 0\n    for i in range(2):\n        if i == 1:\n            total = total + 1\n    return total"
    inject = training.INJECTORS.get(bug, training.off_by_one)
    rows = spark.createDataFrame([(i, code) for i in range(30)], "i int, c string").select(inject(F.col("c"), F.col("i")).alias("x")).collect()
    changed = {r.x for r in rows}
    assert code not in changed
    lines = code.split("\n")
    for x in changed:
        differ = [(a, b) for a, b in zip(lines, x.split("\n")) if a != b]
        assert len(differ) == 1 and len(x.split("\n")) == len(lines)
        if "colon" in bug or "Indentation" in bug:
            with pytest.raises(SyntaxError):
                compile(x, "x", "exec")
        else:
            compile(x, "x", "exec")
    assert (len(changed) > 1) == (bug in ("SyntaxError (missing colon)", "LogicError (wrong operator)", "IndentationError"))


@pytest.mark.parametrize("bug", sorted(training.INJECTORS))
def test_bugs_that_find_no_place(spark, bug):
    assert one(spark, "pass", lambda c: training.INJECTORS[bug](c, F.lit(1))) == "pass"


def test_task_checks(spark):
    obs = [("fizzbuzz", "1 2 FizzBuzz", True), ("fizzbuzz", "FizzBuzz", False), ("palindrome", "True False", True), ("word_count", "The 2", True), ("bugfix_index_error", "Last", True), ("bugfix_index_error", "last Error", False), ("other", "PASS", True), ("other", "PASS Error", False)]
    df = spark.createDataFrame([(t, [o]) for t, o, _ in obs], "t string, o array<string>")
    assert [r.x for r in df.select(ingest.task_check(F.col("t"), F.col("o")).alias("x")).collect()] == [ok for *_, ok in obs]


def test_traces_that_are_not_kept(spark):
    row = spark.createDataFrame([("a", "x", "y")], "code string, o string, p string")
    refactor = lambda a, b, ok: training.refactor_trace(F.col("code"), F.col(a), F.lit(True), F.col("code"), F.col(b), F.lit(ok))
    got = row.select(refactor("o", "o", True), refactor("o", "p", True), refactor("o", "o", False), training.tdd_trace(F.col("code"), F.col("o"), F.col("code"), F.col("p"), F.lit(False))).first()
    assert got[0].count("TOOL_CALL: execute_code(") == 2 and "same output `x`" in got[0] and list(got[1:]) == [None] * 3
    assert json.loads(one(spark, 'a "b"\n\\ é', training.json_text)) == 'a "b"\n\\ é'


def test_write_back(spark):
    from tessera.operators.memory import write_back

    names = ", ".join(f"{k} {'boolean' if k == 'verified' else 'string'}" for k in record())
    rows = [record(content_hash="a"), record(id=None, content_hash=None, verified=None, created_at=None), record(id="2", content_hash="b", observation="FAIL"), record(id="3", content_hash="c"), record(id="4", content_hash="c")]
    df, base = spark.createDataFrame([tuple(r.values()) for r in rows], names), spark.createDataFrame([("a",)], "content_hash string")
    with pytest.raises(RuntimeError, match="not enabled"):
        write_back(base, df)
    out = write_back(base, df, True).collect()
    assert len(out) == 2 and {r.content_hash[:7] for r in out} == {"sha256:", "c"} and all(r.id and r.created_at and r.verified for r in out)


def test_no_task_matches(spark):
    from tessera.operators.curate import chosen_tasks

    with pytest.raises(ValueError, match="no tasks match"):
        chosen_tasks(spark.createDataFrame([("a",)], "id string"), "id", ["b"])
