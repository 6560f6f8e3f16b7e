"""Agent transcripts and memory records made from the driver tables, as SQL that Spark and DuckDB read alike.

The tables hold no protocol markers, so each row of conversations becomes one line of a transcript, of one of twelve
kinds, and each document a memory record whose call has one of nine shapes. Operators take transcripts from anywhere;
these are the inputs of their queries.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lit(s: str) -> str:
    """s as an SQL expression that means the same in both engines: no quote or backslash in a literal."""
    parts = [p for p in re.split(r"(['\"\\\n])", s) if p]
    return "(" + " || ".join(f"chr({ord(p)})" if p in "'\"\\\n" else f"'{p}'" for p in parts) + ")" if parts else "''"


_N = "cast(length(text) as varchar(20))"
KIND = "((conv_id + turn * turn + length(text)) % 12)"
LINE = f"""CASE {KIND}
WHEN 0 THEN {lit('TOOL_CALL: execute_code({"code": "assert f(')} || {_N} || {lit(") == 1" + chr(92) + "nprint('PASS')" + '"})')}
WHEN 1 THEN 'OBSERVATION: PASS'
WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN 'OBSERVATION: ERROR: AssertionError: ' || {_N} ELSE 'OBSERVATION: ERROR: SyntaxError: line ' || {_N} END
WHEN 3 THEN CASE WHEN turn % 2 = 0 THEN 'CRITIQUE: → Solution OK.' ELSE 'CRITIQUE: Fix needed' END
WHEN 4 THEN {lit('TOOL_CALL: word_count({"text": "a"})')}
WHEN 5 THEN 'FINAL_ANSWER: ' || {_N}
WHEN 6 THEN {lit("TOOL_CALL: execute_code({'code': " + '"it' + "'s" + '"})')}
WHEN 7 THEN 'OBSERVATION: (no output)'
WHEN 8 THEN {lit('TOOL_CALL: execute_code({"code": "def f(:"})')}
WHEN 9 THEN 'OBSERVATION: ' || {_N} || ' lines'
WHEN 10 THEN CASE WHEN turn % 2 = 0 THEN 'plain words ' || {_N} ELSE {lit("```python" + chr(10) + "print(")} || {_N} || {lit(")" + chr(10) + "```")} END
ELSE {lit('TOOL_CALL: execute_code({"code": "print(1)"})')} END"""

#: (conv_id, turn, line), and what comes after a line.
ROWS = f"(SELECT conv_id, turn, {LINE} AS line FROM conversations)"
NEXT = f"(SELECT conv_id, turn, line, lead(line) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM {ROWS} AS r)"
#: (conv_id, turn, call, obs) of each call, with what the dispatcher or the tool answered.
CALLS = f"""(SELECT conv_id, turn, substr(line, 12) AS call, CASE WHEN line LIKE 'TOOL_CALL: word_count%' THEN 'ERROR: unknown tool'
WHEN line LIKE 'TOOL_CALL: execute_code({{' || chr(39) || '%' THEN 'ERROR: invalid JSON in tool args'
WHEN after LIKE 'OBSERVATION: %' THEN substr(after, 14) ELSE '' END AS obs FROM {NEXT} AS n WHERE line LIKE 'TOOL_CALL: %')"""
#: DuckDB only: (conv_id, transcript) and its lines (conv_id, i, line).
TRANSCRIPTS = f"(SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript FROM {ROWS} AS r GROUP BY conv_id)"
LINES = f"(SELECT conv_id, unnest(string_split(transcript, chr(10))) AS line, generate_subscripts(string_split(transcript, chr(10)), 1) AS i FROM {TRANSCRIPTS} AS t)"

_SHAPE = "(doc_id % 9)"
_D = "cast(doc_id as varchar(20))"
_BODY = f"{lit('execute_code({' + chr(34) + 'code' + chr(34) + ': ' + chr(34) + 'assert g(')} || {_D} || {lit(')' + chr(34) + '})')}"
CALL = f"""CASE {_SHAPE}
WHEN 0 THEN 'TOOL_CALL: ' || {_BODY}
WHEN 1 THEN '  TOOL_CALL: ' || {_BODY} || ' '
WHEN 2 THEN {_BODY}
WHEN 3 THEN {lit('TOOL_CALL: execute_code({"code": "x"}')}
WHEN 4 THEN {lit("TOOL_CALL: execute_code({'code': 'x'})")}
WHEN 5 THEN {lit('TOOL_CALL: execute_code({"kode": "x"})')}
WHEN 6 THEN {lit('TOOL_CALL: execute_code({"code": "def f(:"})')}
WHEN 7 THEN {lit('TOOL_CALL: execute_code({"code": "VALID: ```x```"})')}
ELSE {lit('TOOL_CALL: execute_code({"code": "x"} )')} END"""
RECORDS = f"""(SELECT doc_id, 'rec-' || {_D} AS id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE substr(text, 1, 40) END AS task, lang AS category,
substr(text, 1, 80) AS query_text, {CALL} AS corrected_tool_call, CASE WHEN doc_id % 5 = 0 THEN 'FAIL' ELSE 'PASS ' || {_D} END AS observation,
CASE WHEN doc_id % 7 = 0 THEN false WHEN doc_id % 11 = 0 THEN NULL ELSE true END AS verified, '2026-01-01' AS created_at,
CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'sha256:' || {_D} END AS content_hash,
CASE WHEN doc_id % 6 = 0 THEN 'FINAL_ANSWER: ```' WHEN doc_id % 6 = 1 THEN '' ELSE 'FINAL_ANSWER: done' END AS final_answer, source FROM documents)"""
#: Lines of three files: (file, number, line); some are blank, comments or broken.
JSON_LINES = f"""(SELECT 'f' || cast(doc_id % 3 as varchar(20)) || '.jsonl' AS file, doc_id AS number, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN '# note'
WHEN 2 THEN {lit('{"id": "broken')} WHEN 3 THEN {lit('{"task": "t"}')} WHEN 4 THEN '   ' WHEN 5 THEN {lit('{"id": "x", "prompt": ""}')}
ELSE {lit('{"id": "d')} || {_D} || {lit('", "prompt": "p')} || {_D} || {lit('", "n": ')} || cast(n_chars as varchar(20)) || '}}' END AS line FROM documents)"""
#: Rows of evaluation files, all values text.
EVAL_ROWS = f"""(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'run' || cast(doc_id % 2 as varchar(20)) || '/single.csv' ELSE 'run' || cast(doc_id % 2 as varchar(20)) || '/best_of_3.csv' END AS path,
CASE doc_id % 8 WHEN 0 THEN 'fizzbuzz' WHEN 1 THEN 'lru_cache' ELSE 'task_' || cast(doc_id % 40 as varchar(20)) END AS id, lang AS category,
CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'True' END AS passed, CASE WHEN doc_id % 5 = 0 THEN 'False' ELSE 'True' END AS passed_via_tool,
CASE WHEN doc_id % 6 = 0 THEN 'True' ELSE 'False' END AS used_fallback_extraction,
CASE doc_id % 7 WHEN 0 THEN 'answer_quality' WHEN 1 THEN '' ELSE 'verified_agent' END AS scoring_mode,
CASE WHEN doc_id % 19 = 0 THEN '' ELSE {lit('TOOL_CALL: execute_code({"code": "y')} || cast(doc_id % 30 as varchar(20)) || {lit('"})' + chr(10) + "OBSERVATION: PASS" + chr(10) + " FINAL_ANSWER: ok ")} END AS full_transcript,
CASE WHEN doc_id % 23 = 0 THEN 'True' ELSE 'False' END AS has_invalid_json, CASE doc_id % 12 WHEN 0 THEN '2' WHEN 1 THEN 'x' ELSE '0' END AS no_output_count,
CASE WHEN doc_id % 14 = 0 THEN 'True' ELSE 'False' END AS has_indentation_error, CASE WHEN doc_id % 15 = 0 THEN 'SyntaxError' ELSE '' END AS first_exception_type,
CASE doc_id % 9 WHEN 0 THEN '1' WHEN 1 THEN '' ELSE '0' END AS n_errors, cast(doc_id % 4 as varchar(20)) AS steps, cast(doc_id % 3 as varchar(20)) AS tool_calls,
CASE doc_id % 11 WHEN 0 THEN 'format problem' WHEN 1 THEN 'misunderstood: wrong task' ELSE '' END AS failure_reason FROM documents)"""


def rows_of(t, sql: str) -> DataFrame:
    """One of the relations above, over the tables of t."""
    names = [n for n in ("conversations", "documents") if f"FROM {n}" in sql]
    bound = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {names[0]}", "FROM {src}")
    return t.spark.sql(f"SELECT * FROM {bound} AS made", src=getattr(t, names[0]))


def transcripts(t) -> DataFrame:
    """(conv_id, transcript)"""
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return rows_of(t, ROWS).groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def tool_calls(t) -> DataFrame:
    """(conv_id, steps, critique, tool_calls): the calls of each transcript in order, as structs of call and obs."""
    calls = F.transform(F.array_sort(F.collect_list(F.struct("turn", "call", "obs"))), lambda x: F.struct(x["call"].alias("call"), x["obs"].alias("obs")))
    by_conv = rows_of(t, CALLS).groupBy("conv_id").agg(calls.alias("tool_calls"))
    whole = transcripts(t).select("conv_id", "transcript")
    return whole.join(by_conv, "conv_id", "left").withColumn("tool_calls", F.coalesce("tool_calls", F.expr("cast(array() as array<struct<call:string,obs:string>>)")))
