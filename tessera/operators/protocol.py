"""Queries on agent transcripts: observations, calls, code, scores, audits, and the filters of training examples."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol as P
from ..functions import scanners
from ..functions.text import normalize_code, percent
from ..plans import transcripts as T
from ..plans.registry import query

_TOOLS = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_TEXT = f"t AS (SELECT * FROM {T.TRANSCRIPTS} AS x)"
_LINES = f"l AS (SELECT * FROM {T.LINES} AS x)"
_CALLS = f"c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM {T.CALLS} AS x)"
#: Each line with whether an observation hides it; the first line never is hidden.
_HIDDEN = f"""{_LINES}, s AS (SELECT *, CASE WHEN i = 1 THEN 0 WHEN starts_with(line, 'OBSERVATION:') THEN 1
WHEN starts_with(line, '<think>') OR starts_with(line, 'TOOL_CALL:') OR starts_with(line, 'CRITIQUE:') OR starts_with(line, 'FINAL_ANSWER:') THEN 0 END AS mark FROM l),
h AS (SELECT conv_id, i, line, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS hidden FROM s)"""


@query("strip_obs", f"WITH {_HIDDEN} SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS stripped FROM h WHERE hidden = 0 GROUP BY 1")
def strip_obs(t):
    return T.transcripts(t).select("conv_id", P.strip_observations(F.col("transcript")).alias("stripped"))


@query("segments", f"""WITH {_HIDDEN}, g AS (SELECT *, sum(CASE WHEN hidden = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS seg
FROM (SELECT *, lag(hidden, 1, -1) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM h))
SELECT conv_id, seg::INT AS seg, CASE WHEN min(i) = 1 THEN '' ELSE chr(10) END || string_agg(line, chr(10) ORDER BY i) AS text, any_value(hidden) = 0 AS supervised FROM g GROUP BY conv_id, seg""")
def segments(t):
    return T.transcripts(t).select("conv_id", F.posexplode(P.segments(F.col("transcript"))).alias("seg", "s")).select("conv_id", "seg", "s.text", "s.supervised")


@query("exception_type", f"""WITH {_TEXT}, {_CALLS}, e AS (SELECT conv_id, k, regexp_extract(obs, '(\\w+Error|\\w+Exception):', 1) AS x FROM c WHERE contains(obs, 'ERROR'))
SELECT conv_id, coalesce(x, '') AS exception FROM t LEFT JOIN (SELECT conv_id, arg_min(x, k) AS x FROM e WHERE x <> '' GROUP BY 1) USING (conv_id)""")
def exception_type(t):
    return T.tool_calls(t).select("conv_id", P.first_exception(F.transform("tool_calls", lambda c: c["obs"])).alias("exception"))


@query("direct_call", f"WITH {_LINES} SELECT conv_id, bool_or(regexp_extract(line, '^TOOL_CALL:\\s*(\\w+)\\s*\\(', 1) NOT IN ('', {_TOOLS(P.EVALUATED_TOOLS)[1:]}) AS direct FROM l GROUP BY 1")
def direct_call(t):
    return T.transcripts(t).select("conv_id", P.direct_call(F.col("transcript")).alias("direct"))


@query("invalid_tools", f"WITH {_LINES} SELECT conv_id, coalesce(string_agg(name, ',' ORDER BY i) FILTER (name NOT IN ('', {_TOOLS(P.TRAINED_TOOLS)[1:]}), '') AS names FROM (SELECT *, regexp_extract(line, 'TOOL_CALL:\\s*(\\w+)\\s*\\(', 1) AS name FROM l) GROUP BY 1")
def invalid_tools(t):
    return T.transcripts(t).select("conv_id", F.array_join(P.invalid_tools(F.col("transcript"), P.TRAINED_TOOLS), ",").alias("names"))


_KIND_SQL = "CASE WHEN starts_with(x, 'TOOL_CALL:') THEN 'TOOL_CALL' WHEN starts_with(x, 'CRITIQUE:') THEN 'CRITIQUE' WHEN starts_with(x, 'FINAL_ANSWER:') THEN 'FINAL_ANSWER' ELSE 'other' END"
_FIRST = f"f AS (SELECT conv_id, first, {_KIND_SQL.replace('x,', 'first,')} AS kind FROM (SELECT conv_id, coalesce(list_filter(list_transform(string_split(transcript, chr(10)), lambda y: trim(y)), lambda y: y <> '')[1], '') AS first FROM t))"


@query("first_line_type", f"WITH {_TEXT}, {_FIRST} SELECT conv_id, kind FROM f")
def first_line_type(t):
    return T.transcripts(t).select("conv_id", P.first_line_type(F.col("transcript")).alias("kind"))


@query("agent_only_filter", f"WITH {_TEXT}, {_FIRST} SELECT conv_id FROM f WHERE kind <> 'other'")
def agent_only_filter(t):
    return T.transcripts(t).where(P.first_line_type(F.col("transcript")) != "other").select("conv_id")


@query("first_line_dist", f"""WITH {_TEXT}, {_FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY conv_id) AS r FROM f)
SELECT kind, count(*) AS n, coalesce(string_agg(left(first, 80), '|' ORDER BY conv_id) FILTER (kind = 'other' AND r <= 3), '') AS examples FROM r GROUP BY 1""")
def first_line_dist(t):
    """How often each type comes first, and the first three lines of no type. Three rows a task meet in the last one."""
    text = F.col("transcript")
    first = F.get(F.filter(F.transform(P.lines(text), P.strip), lambda x: x != ""), F.lit(0))
    kinds = T.transcripts(t).select("conv_id", P.first_line_type(text).alias("kind"), F.left(F.coalesce(first, F.lit("")), F.lit(80)).alias("first"))
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    shown = kinds.where("kind = 'other'").orderBy("conv_id").limit(3).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("conv_id", "first"))).alias("x"))
    return counts.join(F.broadcast(shown), "kind", "left").select("kind", "n", F.coalesce(F.array_join(F.transform("x", lambda x: x["first"]), "|"), F.lit("")).alias("examples"))


@query("final_answer", f"WITH {_TEXT}, {_LINES} SELECT conv_id, coalesce(answer, '') AS answer FROM t LEFT JOIN (SELECT conv_id, arg_min(trim(line), i) AS answer FROM l WHERE starts_with(trim(line), 'FINAL_ANSWER:') GROUP BY 1) USING (conv_id)")
def final_answer(t):
    return T.transcripts(t).select("conv_id", P.final_answer(F.col("transcript")).alias("answer"))


@query("obs_leak", f"WITH {_LINES} SELECT conv_id, bool_or(starts_with(line, 'OBSERVATION: ') AND NOT regexp_matches(substr(line, 14), '^(PASS\\b|ERROR\\b|\\(no output\\)|\\(none\\))')) AS leak FROM l GROUP BY 1")
def obs_leak(t):
    return T.transcripts(t).select("conv_id", P.observation_leak(F.col("transcript")).alias("leak"))


_INSTRUCTION = "CASE conv_id % 3 WHEN 0 THEN 'Do it.' || chr(10) || 'OBSERVATION: (no output)' ELSE 'Do it.' END"


def examples(t) -> DataFrame:
    """(conv_id, instruction, response)"""
    return T.transcripts(t).select("conv_id", F.expr(_INSTRUCTION).alias("instruction"), F.col("transcript").alias("response"))


@query("is_recovery", f"WITH {_TEXT} SELECT conv_id, contains({_INSTRUCTION}, 'OBSERVATION:') OR (instr(transcript, 'OBSERVATION:') > 0 AND contains(substr(transcript, instr(transcript, 'OBSERVATION:')), 'ERROR') AND contains(transcript, 'OBSERVATION: PASS')) AS recovery, contains({_INSTRUCTION}, '(no output)') AS no_output FROM t")
def is_recovery(t):
    i, r = F.col("instruction"), F.col("response")
    return examples(t).select("conv_id", P.is_recovery(i, r).alias("recovery"), F.contains(i, F.lit("(no output)")).alias("no_output"))


@query("pollution_guard", f"WITH {_TEXT} SELECT conv_id, length(transcript) AS n FROM t WHERE NOT contains(transcript, '<|im_start|>')")
def pollution_guard(t):
    """Lengths of texts that are free of prompt markers; one that isn't raises an error."""
    return T.transcripts(t).select("conv_id", F.length(P.guarded(F.col("transcript"))).alias("n"))


@query("banned_markers", f"WITH {_TEXT} SELECT conv_id, array_to_string(list_filter([" + ", ".join(T.lit(m) for m in P.BANNED) + "], lambda m: contains(transcript, m)), ',') AS markers FROM t")
def banned_markers(t):
    return T.transcripts(t).select("conv_id", F.array_join(P.present(F.col("transcript"), P.BANNED), ",").alias("markers"))


@query("critique_flags", f"WITH {_TEXT}, k AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS critique FROM {T.ROWS} AS r WHERE starts_with(line, 'CRITIQUE:') GROUP BY 1) SELECT conv_id, critique IS NOT NULL AS has_critique, coalesce(contains(lower(critique), 'fix needed'), false) AS wants_fix, coalesce(contains(lower(critique), '→ solution ok'), false) AS ok FROM t LEFT JOIN k USING (conv_id)")
def critique_flags(t):
    has, fix, ok = P.critique_flags(F.col("critique"))
    return _runs(t).select("conv_id", has.alias("has_critique"), fix.alias("wants_fix"), ok.alias("ok"))


@query("default_check", f"WITH {_TEXT}, {_CALLS} SELECT conv_id, coalesce(bool_or(contains(obs, 'PASS') AND NOT contains(obs, 'Traceback') AND NOT contains(obs, 'Error')), false) AS ok FROM t LEFT JOIN c USING (conv_id) GROUP BY 1")
def default_check(t):
    return T.tool_calls(t).select("conv_id", P.passes(F.transform("tool_calls", lambda c: c["obs"])).alias("ok"))


@query("normalize_code", f"WITH {_TEXT} SELECT conv_id, md5(array_to_string(list_filter(list_transform(string_split(transcript, chr(10)), lambda x: lower(trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))), lambda x: x <> ''), chr(10))) AS h FROM t")
def normalize_code_query(t):
    return T.transcripts(t).select("conv_id", F.md5(normalize_code(F.col("transcript")).cast("binary")).alias("h"))


# --- calls and their arguments ---


@query("passing_call", f"""WITH {_LINES}, p AS (SELECT conv_id, min(i) FILTER (starts_with(line, 'OBSERVATION: PASS')) AS stop FROM l GROUP BY 1),
x AS (SELECT conv_id, arg_max(line, i) AS line FROM l JOIN p USING (conv_id) WHERE i < stop AND starts_with(line, 'TOOL_CALL: execute_code(') GROUP BY 1)
SELECT conv_id, CASE WHEN json_valid(substr(line, 25, length(line) - 25)) THEN line END AS call FROM p LEFT JOIN x USING (conv_id)""")
def passing_call(t):
    return T.transcripts(t).select("conv_id", scanners.columns()["passing_call"]("transcript").alias("call"))


@query("pending_call")
def pending_call(t):
    """The first call of each transcript: its place, text and end, or -1 where none is complete."""
    return T.transcripts(t).select("conv_id", scanners.columns()["pending_call"]("transcript").alias("found")).select("conv_id", "found.*")


@query("code_bodies", f"""WITH {_LINES}, b AS (SELECT conv_id, i, substr(line, 25, length(line) - 25) AS raw FROM l WHERE starts_with(line, 'TOOL_CALL: execute_code('))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS k, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.code') END AS code FROM b""")
def code_bodies(t):
    return T.transcripts(t).select("conv_id", F.posexplode(scanners.columns()["code_bodies"]("transcript")).alias("k", "code"))


@query("dispatch_class", f"""WITH {_CALLS} SELECT conv_id, k::INT AS k, CASE WHEN NOT regexp_full_match(call, '\\w+\\s*\\(.+\\)') THEN 'unparsable' WHEN regexp_extract(call, '^\\w+') NOT IN {_TOOLS(P.EVALUATED_TOOLS)} THEN 'unknown'
WHEN json_valid(substr(call, 14, length(call) - 14)) THEN 'ok' WHEN json_valid(replace(substr(call, 14, length(call) - 14), chr(39), chr(34))) THEN 'fixed_quotes' ELSE 'invalid_json' END AS class FROM c""")
def dispatch_class(t):
    kind = scanners.dispatch_column(frozenset(P.EVALUATED_TOOLS))
    calls = T.tool_calls(t).select("conv_id", F.posexplode("tool_calls").alias("k", "c"))
    return calls.select("conv_id", (F.col("k") + 1).alias("k"), kind("c.call").alias("class"))


@query("code_parses")
def code_parses(t):
    """Whether each code body is Python; null where its argument is broken JSON."""
    bodies = code_bodies(t)
    return bodies.select("conv_id", "k", F.when(F.col("code").isNotNull(), scanners.columns()["parses"]("code")).alias("parses"))


@query("extract_code")
def extract_code(t):
    return T.transcripts(t).select("conv_id", P.extract_code(F.col("transcript"), scanners.columns()["statement_lines"]).alias("code"))


@query("quality_totals")
def quality_totals(t):
    """Calls, broken arguments, last codes that don't parse, approvals and repeated calls after an error, over all."""
    text = F.col("transcript")
    rows = T.transcripts(t).select(scanners.columns()["quality"](P.strip_observations(text)).alias("q"), P.approves_after_error(text).alias("a"), P.repeats_call_after_error(text).alias("r"))
    return rows.agg(*[F.sum(f"q.{c}").alias(c) for c in ("n_calls", "bad_json", "bad_code")], F.count_if("a").alias("sol_ok_after_error"), F.count_if("r").alias("repeated_call_after_error"))


@query("pass_discipline")
def pass_discipline(t):
    rows = T.transcripts(t).select(scanners.columns()["pass_discipline"]("transcript").alias("p"))
    return rows.agg(*[F.sum(f"p.{c}").alias(c) for c in ("no_print_pass", "no_assert", "early_answer")])


@query("audit_response")
def audit_response(t):
    issues = P.response_issues(F.col("transcript"), scanners.columns()["audit_codes"]("transcript"))
    return T.transcripts(t).select("conv_id", issues.alias("issues")).select("conv_id", F.size("issues").alias("n"), F.array_join("issues", "; ").alias("issues"))


@query("code_leak_flags", f"""WITH {_LINES}, s AS (SELECT conv_id, i, line, CASE WHEN starts_with(line, 'TOOL_CALL:') OR starts_with(line, 'CRITIQUE:') OR starts_with(line, 'FINAL_ANSWER:') THEN 0 WHEN starts_with(line, 'OBSERVATION:') THEN 1 END AS mark FROM l),
h AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS inside FROM s),
b AS (SELECT *, sum(CASE WHEN inside = 1 AND coalesce(was, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS block FROM (SELECT *, lag(inside) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM h)),
e AS (SELECT conv_id, block, bool_or(inside = 1 AND (contains(line, 'Error') OR contains(line, 'ERROR'))) AS failed, arg_min(line, i) FILTER (inside = 1) AS first FROM b WHERE block > 0 GROUP BY 1, 2),
v AS (SELECT conv_id, block, CASE WHEN starts_with(first, 'OBSERVATION: PASS') THEN 0 WHEN failed THEN 1 END AS v, failed FROM e),
w AS (SELECT conv_id, block, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY block), 0) AS failing FROM v),
a AS (SELECT DISTINCT conv_id FROM b JOIN w USING (conv_id, block) WHERE failing = 1 AND contains(lower(line), '→ solution ok')),
k AS (SELECT b.conv_id, i, line, lag(line) OVER q AS prior, block - lag(block) OVER q AS blocks, failed FROM b LEFT JOIN v USING (conv_id, block) WHERE starts_with(line, 'TOOL_CALL:') WINDOW q AS (PARTITION BY b.conv_id ORDER BY i))
SELECT conv_id, conv_id IN (SELECT conv_id FROM a) AS approves, bool_or(coalesce(line = prior AND blocks > 0 AND failed, false)) OVER (PARTITION BY conv_id) IS TRUE AS repeats FROM (SELECT DISTINCT conv_id FROM l) LEFT JOIN k USING (conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i) = 1""")
def code_leak_flags(t):
    """The two flags of audits that follow a failed observation: approval, and the same call again."""
    text = F.col("transcript")
    return T.transcripts(t).select("conv_id", P.approves_after_error(text).alias("approves"), P.repeats_call_after_error(text).alias("repeats"))


# --- memory records ---


def validated(records: DataFrame) -> DataFrame:
    """records with errors, an array that is empty for a valid one, and state, what its call's scanner found."""
    out = records.withColumn("state", scanners.columns()["argument_state"]("corrected_tool_call"))
    return out.withColumn("errors", P.record_errors(F.col, F.col("state")))


_RECORDS = f"r AS (SELECT * FROM {T.RECORDS} AS x)"
_STATE = """CASE WHEN NOT starts_with(trim(corrected_tool_call), 'TOOL_CALL: execute_code(') THEN '' WHEN NOT ends_with(trim(corrected_tool_call), ')') THEN 'unmatched'
WHEN NOT json_valid(substr(trim(corrected_tool_call), 25, length(trim(corrected_tool_call)) - 25)) THEN 'invalid' WHEN json_extract(substr(trim(corrected_tool_call), 25, length(trim(corrected_tool_call)) - 25), '$.code') IS NULL THEN 'no_code' ELSE '' END"""
_ERRORS = (
    [f"CASE WHEN {c} IS NULL THEN {T.lit(f'missing required field: {chr(39)}{c}{chr(39)}')} END" for c in P.REQUIRED]
    + ["CASE WHEN NOT coalesce(verified, false) THEN 'verified must be True' END", f"CASE WHEN NOT contains(coalesce(observation, ''), 'PASS') THEN {T.lit('observation must contain ' + chr(39) + 'PASS' + chr(39))} END"]
    + [f"CASE WHEN NOT starts_with(trim(corrected_tool_call), 'TOOL_CALL: execute_code(') THEN {T.lit('corrected_tool_call must start with ' + chr(39) + 'TOOL_CALL: execute_code(' + chr(39))} END"]
    + [f"CASE WHEN contains({c}, {T.lit(m)}) THEN {T.lit(f'{c}: markdown code fences (```) not allowed' if m == '```' else f'{c}: banned marker {chr(39)}{m}{chr(39)}')} END" for c in ("corrected_tool_call", "final_answer") for m in ["```", *P.BANNED_IN_RECORDS]]
    + [f"CASE WHEN {_STATE} = '{s}' THEN {T.lit('corrected_tool_call: ' + m)} END" for s, m in (("unmatched", "unmatched parenthesis"), ("invalid", "invalid JSON in args"), ("no_code", "args missing 'code' key"))]
)


@query("validate_record", f"WITH {_RECORDS} SELECT doc_id, array_to_string(list_filter([{', '.join(_ERRORS)}], lambda e: e IS NOT NULL), '; ') AS errors FROM r")
def validate_record(t):
    return validated(T.rows_of(t, T.RECORDS)).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("raw_audit")
def raw_audit(t):
    """(total, failed) over raw records: lines that aren't JSON count in both, as does code that isn't Python."""
    bad = (F.size("errors") > 0) | (F.col("state") == "syntax")
    records = validated(T.rows_of(t, T.RECORDS)).select(bad.alias("bad"))
    broken = T.rows_of(t, T.JSON_LINES).where("trim(line) <> '' and not startswith(trim(line), '#')")
    broken = broken.where(F.try_parse_json("line").isNull()).select(F.lit(True).alias("bad"))
    return records.unionByName(broken).agg(F.count("*").alias("total"), F.count_if("bad").alias("failed"))


_SHAPED = """CASE doc_id % 4 WHEN 0 THEN struct_pack(instruction := 'i' || doc_id, response := 'r', task := NULL, call := NULL) WHEN 1 THEN struct_pack(instruction := NULL, response := NULL, task := 't' || doc_id, call := 'c') WHEN 2 THEN struct_pack(instruction := 'i', response := NULL, task := NULL, call := 'c') ELSE struct_pack(instruction := 'i', response := 'r', task := 't', call := 'c') END"""


def as_training_example(df: DataFrame) -> DataFrame:
    """Rows with instruction and response: as they are, else from task and call; rows with neither go."""
    own, other = F.col("instruction").isNotNull() & F.col("response").isNotNull(), F.col("task").isNotNull() & F.col("call").isNotNull()
    pick = lambda a, b: F.when(own, F.col(a)).when(other, F.col(b))
    return df.withColumns({"instruction": pick("instruction", "task"), "response": pick("response", "call")}).where("instruction is not null and response is not null")


@query("as_training_example", f"SELECT doc_id, CASE WHEN x.instruction IS NOT NULL AND x.response IS NOT NULL THEN x.instruction ELSE x.task END AS instruction, CASE WHEN x.instruction IS NOT NULL AND x.response IS NOT NULL THEN x.response ELSE x.call END AS response FROM (SELECT doc_id, {_SHAPED} AS x FROM documents) WHERE (x.instruction IS NOT NULL AND x.response IS NOT NULL) OR (x.task IS NOT NULL AND x.call IS NOT NULL)")
def as_training_example_query(t):
    shape, n = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    rows = t.documents.select(
        "doc_id",
        F.when(shape == 0, F.concat(F.lit("i"), n)).when(shape != 1, "i").alias("instruction"),
        F.when(shape.isin(0, 3), "r").alias("response"),
        F.when(shape == 1, F.concat(F.lit("t"), n)).when(shape == 3, "t").alias("task"),
        F.when(shape != 0, "c").alias("call"),
    )
    return as_training_example(rows).select("doc_id", "instruction", "response")


@query("merge_input", "SELECT doc_id, CASE WHEN trim(i) = '' THEN text ELSE text || chr(10) || chr(10) || trim(i) END AS instruction FROM (SELECT doc_id, trim(left(text, 60), ' ' || chr(10)) AS text, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE ' ' || source END AS i FROM documents) WHERE text <> ''")
def merge_input(t):
    text, extra = P.strip(F.left("text", F.lit(60))), P.strip(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("source"))))
    return t.documents.where(text != "").select("doc_id", F.when(extra == "", text).otherwise(F.concat(text, F.lit("\n\n"), extra)).alias("instruction"))


_CODE = r'(?s)execute_code\(\{"code":\s*"((?:[^"\\]|\\.)*)"\}'


def leaks(call: Column, response: Column) -> Column:
    """Whether a remembered call stands in a response, or both run the same code."""
    body = lambda x: normalize_code(F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), F.regexp_extract(x, _CODE, 1), F.lit('"'))), "$", "string"))
    same = (F.regexp_extract(call, _CODE, 1) != "") & (body(call) != "") & (body(call) == body(response))
    return ((call != "") & F.contains(response, call)) | F.coalesce(same, F.lit(False))


@query("leak_filter", f"WITH {_TEXT}, m AS (SELECT conv_id, transcript, {T.lit('TOOL_CALL: execute_code({' + chr(34) + 'code' + chr(34) + ':  ' + chr(34) + ' PRINT(1)' + chr(34) + '})')} AS call FROM t) SELECT conv_id, contains(transcript, call) OR lower(trim(json_extract_string('{{' || chr(34) || 'c' || chr(34) || ':' || chr(34) || regexp_extract(transcript, 'execute_code\\(\\{{\"code\":\\s*\"((?:[^\"\\\\]|\\\\.)*)\"\\}}', 1) || chr(34) || '}}', '$.c'))) = 'print(1)' AS leak FROM m".replace("{{", "{").replace("}}", "}"))
def leak_filter(t):
    call = F.lit('TOOL_CALL: execute_code({"code":  " PRINT(1)"})')
    return T.transcripts(t).select("conv_id", leaks(call, F.col("transcript")).alias("leak"))


# --- evaluation rows ---

_EVAL = f"e AS (SELECT * FROM {T.EVAL_ROWS} AS x)"
_REASON = """CASE WHEN passed <> 'True' THEN 'passed!=True' WHEN passed_via_tool <> 'True' THEN 'passed_via_tool!=True' WHEN used_fallback_extraction = 'True' THEN 'used_fallback_extraction==True'
WHEN scoring_mode <> '' AND NOT contains(scoring_mode, 'verified') THEN 'scoring_mode=' || chr(39) || scoring_mode || chr(39) || ' not verified' WHEN full_transcript = '' THEN 'empty full_transcript' ELSE '' END"""
_FAILURE = "CASE WHEN has_invalid_json = 'True' THEN 'invalid_json' WHEN coalesce(try_cast(no_output_count AS INT), 0) > 0 THEN 'no_output' WHEN has_indentation_error = 'True' THEN 'indentation_error' WHEN first_exception_type = 'SyntaxError' THEN 'syntax_error' WHEN coalesce(try_cast(n_errors AS INT), 0) > 0 THEN 'assertion_error' ELSE 'none' END"
_CATEGORY = f"CASE WHEN id IN {_TOOLS(P.PRIORITY_TASKS)} THEN 'task_specific_success' WHEN failure = 'no_output' THEN 'no_output_to_pass' WHEN failure = 'invalid_json' THEN 'invalid_json_to_valid_json' WHEN failure = 'assertion_error' THEN 'assertion_error_to_correct_assert' WHEN coalesce(try_cast(n_errors AS INT), 0) > 0 THEN 'failure_to_fix' ELSE 'verified_success' END"


def failure_of(row=F.col) -> Column:
    return P.failure_type(*map(row, ("has_invalid_json", "no_output_count", "has_indentation_error", "first_exception_type", "n_errors")))


@query("row_qualifies", f"WITH {_EVAL} SELECT doc_id, {_REASON} AS reason FROM e")
def row_qualifies(t):
    return T.rows_of(t, T.EVAL_ROWS).select("doc_id", P.reject_reason(F.col).alias("reason"))


@query("failure_type", f"WITH {_EVAL} SELECT doc_id, {_FAILURE} AS failure FROM e")
def failure_type(t):
    return T.rows_of(t, T.EVAL_ROWS).select("doc_id", failure_of().alias("failure"))


@query("memory_category", f"WITH {_EVAL} SELECT doc_id, {_CATEGORY} AS category FROM (SELECT *, {_FAILURE} AS failure FROM e)")
def memory_category(t):
    return T.rows_of(t, T.EVAL_ROWS).select("doc_id", P.memory_category(F.col("id"), failure_of(), F.col("n_errors")).alias("category"))


@query("task_id_token", "SELECT doc_id, coalesce(string_split(trim(q), ' ')[1], '') AS task FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE ' ' || source || ' ' || lang END AS q FROM documents)")
def task_id_token(t):
    q = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat_ws(" ", F.lit(""), F.col("source"), F.col("lang")))
    return t.documents.select("doc_id", F.get(F.split(P.strip(q), r"\s+"), F.lit(0)).alias("task"))


def extract_records(rows: DataFrame, most: int = 500) -> DataFrame:
    """Memory records from rows of evaluation files that pass every gate, each call once, the best `most` of them.

    Files are read in the order of their kind (single before best of three), then path, then row; the first row with a
    call stays. Priority tasks come first, then by category and task.
    """
    call = scanners.columns()["passing_call"]("full_transcript")
    fine = rows.where(P.reject_reason(F.col) == "").withColumn("call", P.strip(call)).where(F.col("call").isNotNull() & (F.size(P.present(F.col("call"), P.BANNED)) == 0))
    failure = failure_of()
    made = fine.withColumns({"failure": failure, "memory": P.memory_category(F.col("id"), failure, F.col("n_errors")), "answer": P.final_answer(F.col("full_transcript"))})
    made = made.where(~P.has_any(F.col("answer"), ["```", *P.BANNED_IN_RECORDS])).where(scanners.columns()["argument_state"]("call").isin("", "syntax"))
    digest = F.sha2(F.concat("id", F.lit("\n"), "call").cast("binary"), 256)
    order = F.struct(F.endswith("path", F.lit("best_of_3.csv")).alias("kind"), "path", "doc_id")
    first = made.withColumns({"hash": F.concat(F.lit("sha256:"), F.left(digest, F.lit(20))), "place": order}).groupBy("hash").agg(F.min_by(F.struct("id", "memory", "failure", "call", "answer", "path", "doc_id"), "place").alias("x")).select("hash", "x.*")
    return first.orderBy((~F.col("id").isin(*P.PRIORITY_TASKS)).cast("int"), "memory", "id", "hash").limit(most)


@query("extract_scan_order", f"WITH {_EVAL} SELECT doc_id, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS row_no, CASE WHEN ends_with(path, '/single.csv') THEN 0 ELSE 1 END AS pattern_no, path FROM e")
def extract_scan_order(t):
    """Where each row comes in the scan: by kind of file, path, and row of the file."""
    from pyspark.sql import Window as W

    pattern = F.when(F.endswith("path", F.lit("/single.csv")), 0).otherwise(1)
    # A window per file: a file is read by one task anyway.
    return T.rows_of(t, T.EVAL_ROWS).select("doc_id", F.row_number().over(W.partitionBy("path").orderBy("doc_id")).alias("row_no"), pattern.alias("pattern_no"), "path")


@query("extract_records", f"""WITH {_EVAL}, g AS (SELECT *, {_REASON} AS reason, {_FAILURE} AS failure, split_part(full_transcript, chr(10), 1) AS call FROM e),
h AS (SELECT *, {_CATEGORY} AS memory, 'sha256:' || left(sha256(id || chr(10) || call), 20) AS hash FROM g WHERE reason = ''),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ends_with(path, 'best_of_3.csv'), path, doc_id) = 1)
SELECT doc_id, id, memory, hash FROM f ORDER BY id NOT IN {_TOOLS(P.PRIORITY_TASKS)}, memory, id, hash LIMIT 500""")
def extract_records_query(t):
    return extract_records(T.rows_of(t, T.EVAL_ROWS)).select("doc_id", "id", "memory", "hash")


@query("classify_failure", f"""WITH {_EVAL} SELECT doc_id, CASE WHEN lower(trim(passed)) IN ('true', '1', 'yes') AND doc_id % 2 = 0 THEN '' WHEN has_invalid_json = 'True' THEN 'wrong_tool_use' WHEN contains(failure_reason, 'format') OR used_fallback_extraction = 'True' THEN 'answer_format_error'
WHEN steps::INT <= 1 AND tool_calls::INT = 0 THEN 'generation_issue' WHEN steps::INT = 1 AND tool_calls::INT > 0 THEN 'incomplete_reasoning' WHEN contains(failure_reason, 'misunderstand') OR contains(failure_reason, 'wrong task') THEN 'prompt_misunderstanding' ELSE 'incomplete_reasoning' END AS class FROM e""")
def classify_failure(t):
    """The kind of each failed run; runs that passed (here: half of those that say so) have none."""
    yes = lambda c: F.lower(P.strip(F.col(c))).isin("true", "1")
    reason, steps, calls = F.lower(P.strip(F.col("failure_reason"))), P.whole(F.col("steps")), P.whole(F.col("tool_calls"))
    passed = F.lower(P.strip(F.col("passed"))).isin("true", "1", "yes") & (F.col("doc_id") % 2 == 0)
    kind = (
        F.when(passed, "")
        .when(yes("has_invalid_json"), "wrong_tool_use")
        .when(F.contains(reason, F.lit("format")) | yes("used_fallback_extraction"), "answer_format_error")
        .when((steps <= 1) & (calls == 0), "generation_issue")
        .when((steps == 1) & (calls > 0), "incomplete_reasoning")
        .when(P.has_any(reason, ["misunderstand", "wrong task"]), "prompt_misunderstanding")
        .otherwise("incomplete_reasoning")
    )
    return T.rows_of(t, T.EVAL_ROWS).select("doc_id", kind.alias("class"))


#: The columns of a failure analysis.
ANALYSIS = "id category mode passed passed_via_tool passed_via_fallback tool_calls n_errors failure_reason first_exception_type has_indentation_error has_invalid_json has_unknown_tool has_direct_task_tool_call repeated_identical_tool_call_count has_solution_ok_after_error used_fallback_extraction".split()


def failure_analysis(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs' rows under the fixed columns, as text; mode names the run, and what a run lacks is empty."""
    parts = [df.withColumn("mode", F.lit(label)) for label, df in runs.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in both.columns else F.lit("")
    return both.select(*[have(c).alias(c) for c in ANALYSIS])


def _analysed(c: str) -> str:
    return {"mode": "mode"}.get(c) or (f"coalesce({c}, '')" if c in ("id", "category", "passed", "n_errors", "failure_reason", "used_fallback_extraction") else "coalesce(b, '')" if c == "first_exception_type" else "''") + f" AS {c}"


@query("failure_analysis", f"WITH {_EVAL} SELECT {', '.join(map(_analysed, ANALYSIS))} FROM (SELECT 'a' AS mode, id, category, passed, n_errors, failure_reason, used_fallback_extraction, NULL AS b FROM e WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', id, category, passed, NULL, failure_reason, NULL, first_exception_type FROM e WHERE doc_id % 2 = 1)")
def failure_analysis_query(t):
    rows = T.rows_of(t, T.EVAL_ROWS)
    a = rows.where("doc_id % 2 = 0").select("id", "category", "passed", "n_errors", "failure_reason", "used_fallback_extraction")
    b = rows.where("doc_id % 2 = 1").select("id", "category", "passed", "failure_reason", "first_exception_type")
    return failure_analysis({"a": a, "b": b})


# --- scores ---


def _runs(t) -> DataFrame:
    """(conv_id, transcript, tool_calls, critique, answer, steps)"""
    lines = F.collect_list(F.when(F.startswith("line", F.lit("CRITIQUE:")), F.struct("turn", "line")))
    said = T.rows_of(t, T.ROWS).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n").alias("critique"), F.count("*").alias("steps"))
    return T.tool_calls(t).join(said, "conv_id").withColumn("answer", P.final_answer(F.col("transcript")))


def score_rows(runs: DataFrame, mode: str = "verified_agent") -> DataFrame:
    """One row of flags and counts for each recorded run; runs has what _runs gives.

    Code isn't run here: in the mode answer_quality a run passes if a tool did, or if the column fallback_obs
    (array<string>, what running the extracted code gave) is there and passes.
    """
    calls, text = F.col("tool_calls"), F.col("transcript")
    obs = F.transform(calls, lambda c: c["obs"])
    errors = F.filter(obs, lambda o: F.startswith(o, F.lit("ERROR")))
    n = lambda f: F.size(F.filter(obs, f))
    starts = lambda o, s: F.startswith(o, F.lit(s))
    unknown, broken = n(lambda o: starts(o, "ERROR: unknown tool")), n(lambda o: starts(o, "ERROR: invalid JSON"))
    has, wants, approves = P.critique_flags(F.col("critique"))
    by_tool = P.passes(obs)
    approved = (F.size(errors) > 0) & ~by_tool & approves
    silent = lambda o: P.strip(o).isin("", "(no output)")
    won = lambda o: F.startswith(P.strip(o), F.lit("PASS"))
    failed = lambda o: starts(o, "ERROR")
    run = F.filter(calls, lambda c: F.contains(c["call"], F.lit("execute_code")))
    ran = F.transform(run, lambda c: c["obs"])
    # The n-th run's code: calls are scanned as one text, which holds them in order; a call that can't be read is null.
    code = F.transform(scanners.columns()["code_bodies_of_calls"](F.transform(run, lambda c: c["call"])), lambda x: F.coalesce(x, F.lit("")))
    each = F.arrays_zip(ran.alias("obs"), code.alias("code"))
    count = lambda f: F.size(F.filter(each, lambda e: f(e["obs"], e["code"])))
    prints = lambda c: P.has_any(c, ["print('PASS')", 'print("PASS")'])
    first_win = F.array_position(F.transform(ran, won), True)
    wins, had_error, had_silence = F.exists(ran, won), F.exists(ran, failed), F.exists(ran, silent)
    syntax = F.exists(ran, lambda o: P.has_any(o, ["SyntaxError", "IndentationError"]))
    indent = F.exists(ran, lambda o: F.contains(o, F.lit("IndentationError")))
    size = F.size(calls)
    fallback = F.coalesce(F.exists("fallback_obs", lambda o: F.contains(o, F.lit("PASS")) & ~F.contains(o, F.lit("Traceback"))), F.lit(False)) if "fallback_obs" in runs.columns else F.lit(False)
    fallback = fallback & ~by_tool & F.lit(mode == "answer_quality")
    passed = by_tool | fallback
    early = F.when(size == 0, "no_tool_call").when(unknown == size, "unknown_tool").when(broken == size, "invalid_tool_json")
    late = F.when(approved, "solution_ok_after_error").otherwise("tool_call_no_pass") if mode == "verified_agent" else F.lit("no_extracted_code")
    reason = F.when(passed, "").otherwise(F.coalesce(early, late))
    out = {
        "passed": passed, "has_critique": has, "critique_ok": approves, "fix_loop": wants & passed, "n_tool_calls": size, "n_errors": F.size(errors),
        "first_tool_call": F.left(F.coalesce(F.get(calls, F.lit(0))["call"], F.lit("")), F.lit(200)), "unknown_tool_count": unknown, "invalid_json_count": broken,
        "observations": F.left(F.array_join(obs, "\n---\n"), F.lit(4000)), "failure_reason": reason, "passed_via_tool": by_tool, "passed_via_fallback": fallback,
        "first_exception_type": P.first_exception(errors), "has_indentation_error": F.exists(errors, lambda o: F.contains(o, F.lit("IndentationError"))),
        "has_invalid_json": broken > 0, "has_unknown_tool": unknown > 0, "has_direct_task_tool_call": P.direct_call(text),
        "repeated_identical_tool_call_count": P.repeats(F.transform(P.called_names(text), lambda x: x)), "has_solution_ok_after_error": approved, "used_execute_code": F.size(run) > 0,
        "no_pass_print_count": count(lambda o, c: ~failed(o) & ~won(o) & ~silent(o) & ~prints(c)), "no_assert_count": count(lambda _, c: (c != "") & ~F.contains(c, F.lit("assert "))),
        "no_output_count": F.size(F.filter(ran, silent)), "invalid_json_retry_count": F.size(F.filter(calls, lambda c, i: F.contains(c["call"], F.lit("execute_code")) & starts(c["obs"], "ERROR: invalid JSON") & (i > 0))),
        "first_call_passed": F.coalesce(won(F.get(ran, F.lit(0))), F.lit(False)), "eventually_passed": wins, "recovered_after_error": had_error & wins, "recovered_after_no_output": had_silence & wins,
        "repeated_same_error_count": F.size(F.filter(ran, lambda o, i: (i > 0) & failed(o) & (o == F.get(ran, i - 1)))),
        "pass_after_syntax_fix": syntax & wins, "pass_after_indent_fix": indent & wins, "unnecessary_retry_after_pass": (first_win > 0) & (first_win < F.size(ran)),
    }
    return runs.select("conv_id", "steps", *[c.alias(k) for k, c in out.items()])


_SCORE = f"""{_TEXT}, {_LINES}, {_CALLS}, y AS (SELECT conv_id, count(*) AS steps, coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (starts_with(line, 'CRITIQUE:')), '') AS critique FROM {T.ROWS} AS r GROUP BY 1),
x AS (SELECT *, contains(call, 'execute_code') AS run, starts_with(obs, 'ERROR') AS failed, starts_with(trim(obs), 'PASS') AS won, trim(obs) IN ('', '(no output)') AS silent, CASE WHEN contains(call, 'execute_code') AND json_valid(substr(call, 14, length(call) - 14)) THEN coalesce(json_extract_string(substr(call, 14, length(call) - 14), '$.code'), '') ELSE '' END AS code FROM c),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY k) AS rk, lag(obs) OVER (PARTITION BY conv_id, run ORDER BY k) AS prior FROM x),
a AS (SELECT conv_id, count(*)::INT AS n_tool_calls, count_if(failed)::INT AS n_errors, left(arg_min(call, k), 200) AS first_tool_call, count_if(starts_with(obs, 'ERROR: unknown tool'))::INT AS unknown_tool_count, count_if(starts_with(obs, 'ERROR: invalid JSON'))::INT AS invalid_json_count,
 left(string_agg(obs, chr(10) || '---' || chr(10) ORDER BY k), 4000) AS observations, bool_or(contains(obs, 'PASS') AND NOT contains(obs, 'Traceback') AND NOT contains(obs, 'Error')) AS by_tool,
 arg_min(regexp_extract(obs, '(\\w+Error|\\w+Exception):', 1), k) FILTER (failed AND regexp_extract(obs, '(\\w+Error|\\w+Exception):', 1) <> '') AS exc, bool_or(failed AND contains(obs, 'IndentationError')) AS has_indentation_error, bool_or(run) AS used_execute_code,
 count_if(run AND NOT failed AND NOT won AND NOT silent AND NOT contains(code, 'print(' || chr(39) || 'PASS' || chr(39) || ')') AND NOT contains(code, 'print(' || chr(34) || 'PASS' || chr(34) || ')'))::INT AS no_pass_print_count, count_if(run AND code <> '' AND NOT contains(code, 'assert '))::INT AS no_assert_count, count_if(run AND silent)::INT AS no_output_count,
 count_if(run AND starts_with(obs, 'ERROR: invalid JSON') AND k > 1)::INT AS invalid_json_retry_count, coalesce(bool_or(won) FILTER (run AND rk = 1), false) AS first_call_passed, coalesce(bool_or(won) FILTER (run), false) AS eventually_passed, coalesce(bool_or(failed) FILTER (run), false) AS had_error, coalesce(bool_or(silent) FILTER (run), false) AS had_silence,
 count_if(run AND failed AND obs = prior)::INT AS repeated_same_error_count, coalesce(bool_or(contains(obs, 'SyntaxError') OR contains(obs, 'IndentationError')) FILTER (run), false) AS syntax, coalesce(bool_or(contains(obs, 'IndentationError')) FILTER (run), false) AS indent, min(rk) FILTER (run AND won) AS first_win, count_if(run) AS runs FROM z GROUP BY 1),
d AS (SELECT conv_id, coalesce(bool_or(name NOT IN ('', {_TOOLS(P.EVALUATED_TOOLS)[1:]}), false) AS direct, (count_if(name <> '') - count(DISTINCT name) FILTER (name <> ''))::INT AS repeated FROM (SELECT conv_id, regexp_extract(line, '^TOOL_CALL:\\s*(\\w+)\\s*\\(', 1) AS name FROM l) GROUP BY 1),
b AS (SELECT conv_id, steps, critique, coalesce(n_tool_calls, 0) AS n_tool_calls, coalesce(n_errors, 0) AS n_errors, coalesce(first_tool_call, '') AS first_tool_call, coalesce(unknown_tool_count, 0) AS unknown_tool_count, coalesce(invalid_json_count, 0) AS invalid_json_count, coalesce(observations, '') AS observations, coalesce(by_tool, false) AS passed, coalesce(exc, '') AS first_exception_type, coalesce(has_indentation_error, false) AS has_indentation_error,
 direct AS has_direct_task_tool_call, repeated AS repeated_identical_tool_call_count, coalesce(used_execute_code, false) AS used_execute_code, coalesce(no_pass_print_count, 0) AS no_pass_print_count, coalesce(no_assert_count, 0) AS no_assert_count, coalesce(no_output_count, 0) AS no_output_count, coalesce(invalid_json_retry_count, 0) AS invalid_json_retry_count, coalesce(first_call_passed, false) AS first_call_passed, coalesce(eventually_passed, false) AS eventually_passed,
 coalesce(had_error AND eventually_passed, false) AS recovered_after_error, coalesce(had_silence AND eventually_passed, false) AS recovered_after_no_output, coalesce(repeated_same_error_count, 0) AS repeated_same_error_count, coalesce(syntax AND eventually_passed, false) AS pass_after_syntax_fix, coalesce(indent AND eventually_passed, false) AS pass_after_indent_fix, coalesce(first_win < runs, false) AS unnecessary_retry_after_pass,
 critique <> '' AS has_critique, contains(lower(critique), '→ solution ok') AS critique_ok, contains(lower(critique), 'fix needed') AS wants FROM y JOIN d USING (conv_id) LEFT JOIN a USING (conv_id)),
score AS (SELECT conv_id, steps, passed, has_critique, critique_ok, wants AND passed AS fix_loop, n_tool_calls, n_errors, first_tool_call, unknown_tool_count, invalid_json_count, observations,
 CASE WHEN passed THEN '' WHEN n_tool_calls = 0 THEN 'no_tool_call' WHEN unknown_tool_count = n_tool_calls THEN 'unknown_tool' WHEN invalid_json_count = n_tool_calls THEN 'invalid_tool_json' WHEN n_errors > 0 AND critique_ok THEN 'solution_ok_after_error' ELSE 'tool_call_no_pass' END AS failure_reason,
 passed AS passed_via_tool, false AS passed_via_fallback, first_exception_type, has_indentation_error, invalid_json_count > 0 AS has_invalid_json, unknown_tool_count > 0 AS has_unknown_tool, has_direct_task_tool_call, repeated_identical_tool_call_count, n_errors > 0 AND NOT passed AND critique_ok AS has_solution_ok_after_error, used_execute_code, no_pass_print_count, no_assert_count, no_output_count, invalid_json_retry_count, first_call_passed, eventually_passed, recovered_after_error, recovered_after_no_output, repeated_same_error_count, pass_after_syntax_fix, pass_after_indent_fix, unnecessary_retry_after_pass FROM b)"""


@query("score_row", f"WITH {_SCORE} SELECT * FROM score")
def score_row(t):
    return score_rows(_runs(t))


RATES = {"pass_rate": "passed", "verified_tool_pass": "passed_via_tool", "fallback_pass_rate": "passed_via_fallback", "critique_rate": "has_critique", "fix_loop_rate": "fix_loop", "error_rate": "n_errors > 0", "executed_code_rate": "used_execute_code", "real_tool_rate": "n_tool_calls > 0"}
SUMS = {"unknown_tool_total": "unknown_tool_count", "invalid_json_total": "invalid_json_count", "repeated_call_total": "repeated_identical_tool_call_count", "no_pass_print_total": "no_pass_print_count", "no_assert_total": "no_assert_count", "no_output_total": "no_output_count", "invalid_json_retry_total": "invalid_json_retry_count", "repeated_same_error_total": "repeated_same_error_count"}
COUNTS = {"indent_error_count": "has_indentation_error", "sol_ok_after_error_count": "has_solution_ok_after_error", **{f"{c}_count": c for c in ("first_call_passed", "eventually_passed", "recovered_after_error", "recovered_after_no_output", "pass_after_syntax_fix", "pass_after_indent_fix", "unnecessary_retry_after_pass")}}


def run_summary(scores: DataFrame) -> DataFrame:
    """One row: rates in percent, averages, totals, and how often each reason of failure occurred."""
    reasons = scores.where("failure_reason <> ''").groupBy("failure_reason").agg(F.count("*").alias("k"))
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "failure_reason", F.col("k").cast("string"))))
    mean = lambda c: F.bround(F.avg(c), 1)
    one = scores.agg(
        F.count("*").alias("n"),
        *[percent(F.count_if(F.expr(e)), F.count("*")).alias(k) for k, e in RATES.items()],
        mean("steps").alias("avg_steps"), mean("n_tool_calls").alias("avg_tools"),
        *[F.sum(c).alias(k) for k, c in SUMS.items()], *[F.count_if(c).alias(k) for k, c in COUNTS.items()],
    )
    return one.crossJoin(F.broadcast(reasons.agg(F.array_join(listed, ",").alias("failure_counts"))))  # a row each


@query("run_summary", f"WITH {_SCORE} SELECT count(*) AS n, {', '.join(f'round_even(100.0 * count_if({e})::DOUBLE / count(*), 1) AS {k}' for k, e in RATES.items())}, round_even(avg(steps), 1) AS avg_steps, round_even(avg(n_tool_calls), 1) AS avg_tools, {', '.join(f'sum({c})::BIGINT AS {k}' for k, c in SUMS.items())}, {', '.join(f'count_if({c})::BIGINT AS {k}' for k, c in COUNTS.items())}, (SELECT string_agg(failure_reason || ':' || k, ',' ORDER BY failure_reason || ':' || k) FROM (SELECT failure_reason, count(*) AS k FROM score WHERE failure_reason <> '' GROUP BY 1)) AS failure_counts FROM score")
def run_summary_query(t):
    return run_summary(score_row(t))
