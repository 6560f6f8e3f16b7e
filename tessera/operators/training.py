"""Queries that prepare training data: pads, masks, decoding, trace builders, mixtures, bug injection, patches."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol as P
from ..functions.text import char_tokens
from ..plans import transcripts as T
from ..plans.registry import query
from ..store.terms import common_grams, sums
from . import protocol

IGNORED = -100


def _fill(n: Column, value: int) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)))


def pad_shift(tokens: Column, size: int) -> tuple[Column, Column]:
    """(inputs, labels) of size tokens each: labels are inputs moved by one; what is short is filled with 0."""
    cut = F.slice(tokens, 1, size + 1)
    full = F.concat(cut, _fill(size + 1 - F.size(cut), 0))
    return F.slice(full, 1, size), F.slice(full, 2, size)


@query("pad_shift", "SELECT doc_id, array_to_string(x[1:64], ',') AS inputs, array_to_string(x[2:65], ',') AS labels FROM (SELECT doc_id, list_transform(range(1, 66), lambda i: CASE WHEN i <= length(text) THEN unicode(substr(text, i, 1)) % 256 ELSE 0 END) AS x FROM documents)")
def pad_shift_query(t):
    x, y = pad_shift(char_tokens(F.left("text", F.lit(65)), 256), 64)
    return t.documents.select("doc_id", F.array_join(x.cast("array<string>"), ",").alias("inputs"), F.array_join(y.cast("array<string>"), ",").alias("labels"))


@query("char_decode", "SELECT doc_id, array_to_string(list_transform(range(1, least(length(text), 50) + 1), lambda i: chr(least(unicode(substr(text, i, 1)), 127))), '') AS s FROM documents")
def char_decode(t):
    return t.documents.select("doc_id", P.char_decode(char_tokens(F.left("text", F.lit(50)), 1 << 21)).alias("s"))


def mask_prompt(prompt: Column, response: Column, size: int) -> Column:
    """Struct (input_ids, labels) of size tokens: prompt and padding are ignored, what is too long is cut at the end."""
    ids = F.slice(F.concat(prompt, response), 1, size)
    masked = F.least(F.size(prompt), F.size(ids))
    labels = F.concat(_fill(masked, IGNORED), F.slice(ids, masked + 1, F.greatest(F.size(ids) - masked, F.lit(0))))
    return F.struct(F.concat(ids, _fill(size - F.size(ids), 0)).alias("input_ids"), F.concat(labels, _fill(size - F.size(labels), IGNORED)).alias("labels"))


@query("mask_prompt_len", "SELECT doc_id, array_to_string(list_transform(range(1, 41), lambda i: CASE WHEN i <= length(lang || source) THEN -100 WHEN i <= length(lang || source || text) THEN unicode(substr(lang || source || text, i, 1)) ELSE -100 END), ',') AS labels, list_sum(list_transform(range(1, 41), lambda i: CASE WHEN i <= length(lang || source || text) THEN unicode(substr(lang || source || text, i, 1)) ELSE 0 END))::BIGINT AS ids FROM documents")
def mask_prompt_len(t):
    chars = lambda c: char_tokens(c, 1 << 21)
    m = t.documents.select("doc_id", mask_prompt(chars(F.concat("lang", "source")), chars(F.left("text", F.lit(40))), 40).alias("m"))
    return m.select("doc_id", F.array_join(F.col("m.labels").cast("array<string>"), ",").alias("labels"), F.aggregate("m.input_ids", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("ids"))


def mask_segments(prompt: Column, response: Column, size: int, tokens) -> Column:
    """Struct (input_ids, labels): prompt and observations are ignored; the prompt is cut at its start so that the whole
    response fits; null if the response doesn't fit alone. tokens: text column -> array of ids."""
    parts = F.transform(P.segments(response), lambda s: F.struct(tokens(s["text"]).alias("ids"), s["supervised"].alias("supervised")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    labels = F.flatten(F.transform(parts, lambda p: F.when(p["supervised"], p["ids"]).otherwise(_fill(F.size(p["ids"]), IGNORED))))
    before = tokens(prompt)
    keep = F.least(F.size(before), size - F.size(ids))
    head = F.when(keep > 0, F.slice(before, F.greatest(F.size(before) - keep + 1, F.lit(1)), F.greatest(keep, F.lit(0)))).otherwise(F.slice(before, 1, 0))
    made = F.struct(F.concat(head, ids).alias("input_ids"), F.concat(_fill(F.size(head), IGNORED), labels).alias("labels"))
    return F.when(F.size(ids) < size, made)


_HIDDEN = protocol._HIDDEN
_MASKED = f"{_HIDDEN}, q AS (SELECT conv_id, sum(length(line) + CASE WHEN i = 1 THEN 0 ELSE 1 END)::INT AS target, coalesce(sum(length(line) + CASE WHEN i = 1 THEN 0 ELSE 1 END) FILTER (hidden = 0), 0)::INT AS supervised FROM h GROUP BY 1), w AS (SELECT *, least(6, 400 - target)::INT AS kept FROM q WHERE target < 400)"


@query("mask_segments", f"WITH {_MASKED} SELECT conv_id, kept + target AS n, supervised FROM w")
def mask_segments_query(t):
    m = protocol.examples(t).select("conv_id", mask_segments(F.left("instruction", F.lit(6)), F.col("response"), 400, lambda c: char_tokens(c, 1 << 21)).alias("m")).where("m is not null")
    return m.select("conv_id", F.size("m.input_ids").alias("n"), F.size(F.filter("m.labels", lambda x: x != IGNORED)).alias("supervised"))


def mask_audit(masked: DataFrame) -> DataFrame:
    """Rows of input_ids and labels with what is wrong: no supervised token, a prompt that isn't masked, more than
    80 % supervised, or a supervised text whose first 80 characters stand in the ignored part before it."""
    ids, labels = F.col("input_ids"), F.col("labels")
    n = F.size(F.filter(labels, lambda x: x != IGNORED))
    first = F.array_position(F.transform(labels, lambda x: x != IGNORED), True)
    text = P.char_decode(F.filter(F.transform(ids, lambda x, i: F.when(F.get(labels, i) != IGNORED, x)), lambda x: x.isNotNull()))
    before = P.char_decode(F.slice(ids, 1, F.when(first > 0, first - 1).otherwise(F.size(ids)).cast("int")))
    leak = (F.length(text) > 80) & F.contains(before, P.strip(F.left(text, F.lit(80))))
    return masked.withColumns({"n_supervised": n, "none": n == 0, "unmasked": first == 1, "mostly": n > 0.8 * F.size(ids), "leak": leak})


@query("mask_audit", f"WITH {_MASKED} SELECT count(*) AS n, sum(supervised)::BIGINT AS n_supervised, count_if(supervised = 0)::BIGINT AS none, 0::BIGINT AS unmasked, count_if(supervised > 0.8 * (kept + target))::BIGINT AS mostly, 0::BIGINT AS leak FROM w")
def mask_audit_query(t):
    m = protocol.examples(t).select(mask_segments(F.left("instruction", F.lit(6)), F.col("response"), 400, lambda c: char_tokens(c, 1 << 21)).alias("m")).where("m is not null")
    return mask_audit(m.select("m.*")).agg(F.count("*").alias("n"), F.sum("n_supervised").alias("n_supervised"), *[F.count_if(c).alias(c) for c in ("none", "unmasked", "mostly", "leak")])


# --- traces ---


def json_text(c: Column) -> Column:
    """A JSON string of c; letters other than ASCII stay as they are."""
    whole = F.to_json(F.struct(c.alias("c")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def fmt_call(tool: str, code: Column) -> Column:
    return F.concat(F.lit(f'TOOL_CALL: {tool}({{"code": '), json_text(code), F.lit("})"))


def _name(code: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(code, r"def (\w+)", 1), F.lit("")), F.lit("the solution"))


#: What traces say, and the marks before and after what they show. {} stands for a part that is put in.
SAYS = {
    "obs": "\nOBSERVATION: ",
    "verify": "<think>I'll implement {} and verify it runs correctly.</think>\n",
    "verified": "\nFINAL_ANSWER: Implementation verified. Output: `{}`\n\n```python\n{}\n```",
    "fix": "<think>Let me run the code to see the actual error.</think>\n",
    "fix_found": "\n<think>The error is a {}. I'll fix it now.</think>\n",
    "fixed": "\nFINAL_ANSWER: Fixed a {}. Output: `{}`",
    "refactor": "<think>I'll run the original code first to confirm it works, then refactor it and verify the output is unchanged.</think>\n",
    "refactor_next": "\n<think>Works correctly. Now I'll write the cleaner version.</think>\n",
    "refactored": "\nFINAL_ANSWER: Refactored successfully — same output `{}`. Improved version:\n\n```python\n{}\n```",
    "tdd": "<think>I'll write the tests first, then implement the function.</think>\n",
    "tdd_next": "\n<think>Tests confirm the function isn't defined yet. Now I'll implement it.</think>\n",
    "tdd_done": "\nFINAL_ANSWER: All tests pass. Implementation:\n\n```python\n{}\n```",
    "multi": "<think>Let me run it first to confirm the error.</think>\n",
    "multi_found": "\n<think>I see the issue ({}). Let me apply the fix.</think>\n",
    "multi_fixed": "\nFINAL_ANSWER: Fixed the {}. Verified output: `{}`",
    "benchmark": "<think>I'll implement {} with assert-based verification.</think>\n",
    "benchmark_critique": "\nCRITIQUE:\nCorrectness — All assertions pass.\nEdge cases  — Verified with boundary inputs.\nRequirements— Implementation matches the task description.\n→ Solution OK.",
    "benchmark_done": "\nFINAL_ANSWER: All assertions passed.\n\n```python\n{}\n```",
}


def said(what: str, *parts: Column) -> Column:
    """The sentence with its parts put in."""
    pieces = SAYS[what].split("{}")
    return F.concat(F.lit(pieces[0]), *[x for p, rest in zip(parts, pieces[1:]) for x in (p, F.lit(rest))])


def _ran(code: Column, obs: Column) -> Column:
    return F.concat(fmt_call("execute_code", code), said("obs"), obs)


def verify_trace(code: Column, obs: Column) -> Column:
    """Code that is written, run once and shown."""
    return F.concat(said("verify", _name(code)), _ran(code, obs), said("verified", F.left(obs, F.lit(60)), code))


def fix_trace(bad: Column, bad_obs: Column, code: Column, obs: Column, kind: Column) -> Column:
    """Code that fails, and its correction."""
    return F.concat(said("fix"), _ran(bad, bad_obs), said("fix_found", kind), _ran(code, obs), said("fixed", kind, F.left(obs, F.lit(60))))


def refactor_trace(old: Column, old_obs: Column, old_ok: Column, new: Column, new_obs: Column, new_ok: Column) -> Column:
    """A refactoring; null unless both run and print the same."""
    made = F.concat(said("refactor"), _ran(old, old_obs), said("refactor_next"), _ran(new, new_obs), said("refactored", F.left(old_obs, F.lit(50)), new))
    return F.when(old_ok & new_ok & (old_obs == new_obs), made)


def tdd_trace(tests: Column, fail_obs: Column, code: Column, obs: Column, ok: Column) -> Column:
    """Tests first, then code; null unless the code runs."""
    shown = P.strip(F.get(F.split(code, "def test_"), F.lit(0)))
    return F.when(ok, F.concat(said("tdd"), _ran(tests, fail_obs), said("tdd_next"), _ran(code, obs), said("tdd_done", shown)))


def multi_fix_trace(bad: Column, bad_obs: Column, bad_ok: Column, code: Column, obs: Column, kind: Column) -> Column:
    """Two rounds: code that fails, and its correction in place; null if the change changes nothing or runs all the same."""
    made = F.concat(said("multi"), _ran(bad, bad_obs), said("multi_found", kind), _ran(code, obs), said("multi_fixed", kind, F.left(obs, F.lit(60))))
    return F.when((bad != code) & ~bad_ok, made)


def benchmark_trace(code: Column, obs: Column, ok: Column) -> Column:
    """Code that brings its own assertions, with a critique; the code before them is shown. Null unless it runs."""
    shown = P.strip(F.get(F.split(code, "\nassert"), F.lit(0)))
    return F.when(ok, F.concat(said("benchmark", _name(code)), _ran(code, obs), said("benchmark_critique"), said("benchmark_done", shown)))


_PY = f"'def f' || doc_id || '():' || chr(10) || {T.lit('    return ' + chr(34) + 'x' + chr(34))}"


@query("trajectory_text", f"""WITH c AS (SELECT doc_id, {_PY} AS code, left(text, 70) AS obs, doc_id % 4 AS kind FROM documents)
SELECT doc_id, CASE WHEN kind = 0 THEN '<think>I' || chr(39) || 'll implement f' || doc_id || ' and verify it runs correctly.</think>' || chr(10) || call || 'FINAL_ANSWER: Implementation verified. Output: `' || left(obs, 60) || '`' || chr(10) || chr(10) || '```python' || chr(10) || code || chr(10) || '```'
WHEN kind = 1 THEN NULL WHEN kind = 2 AND doc_id % 3 = 0 THEN NULL ELSE '' END AS trace FROM (SELECT *, 'TOOL_CALL: execute_code({{' || chr(34) || 'code' || chr(34) || ': ' || to_json(code)::VARCHAR || '}})' || chr(10) || 'OBSERVATION: ' || obs || chr(10) AS call FROM c)""")
def trajectory_text(t):
    """A verified trace; a refactoring whose outputs differ, which isn't kept; TDD traces without code that runs."""
    code, obs, kind, n = F.expr(_PY.replace("|| doc_id ||", "|| cast(doc_id as string) ||")), F.left("text", F.lit(70)), F.col("doc_id") % 4, F.col("doc_id")
    refactored = refactor_trace(code, obs, F.lit(True), code, F.concat(obs, F.lit("!")), F.lit(True))
    tdd = F.when(tdd_trace(code, obs, code, obs, n % 3 != 0).isNotNull(), "")
    return t.documents.select("doc_id", F.when(kind == 0, verify_trace(code, obs)).when(kind == 1, refactored).when(kind == 2, tdd).otherwise("").alias("trace"))


def _sql_said(what: str, *parts: str) -> str:
    pieces = [T.lit(x) for x in SAYS[what].split("{}")]
    return " || ".join([pieces[0], *[x for p, rest in zip(parts, pieces[1:]) for x in (p, rest)]])


_CALL_OF = lambda code: f"{T.lit('TOOL_CALL: execute_code({' + chr(34) + 'code' + chr(34) + ': ')} || to_json({code})::VARCHAR || '}})'"
_RAN = lambda code, obs: f"{_CALL_OF(code).replace('}})', '})')} || {_sql_said('obs')} || {obs}"
_KIND = "CASE kind % 2 WHEN 0 THEN 'SyntaxError (missing colon)' ELSE 'NameError' END"
_FIX_ROWS = "SELECT doc_id, ('0x' || left(md5('trace:' || doc_id), 8))::BIGINT % 6 AS kind, text AS obs FROM documents"
_MADE = f"'def f' || doc_id || '():' || chr(10) || '    return ' || length(obs)"


@query("trajectory_fixes", f"""WITH d AS ({_FIX_ROWS}), c AS (SELECT *, {_MADE} AS code, replace({_MADE}, '():', '()') AS bad, 'ERROR: ' || left(obs, 40) AS err FROM d), n AS (SELECT *, {_KIND} AS name, 'f' || doc_id AS f, code || chr(10) || 'assert f' || doc_id || '()' AS tested FROM c)
SELECT doc_id, md5(CASE kind WHEN 0 THEN {_sql_said('fix')} || {_RAN('bad', 'err')} || {_sql_said('fix_found', 'name')} || {_RAN('code', 'obs')} || {_sql_said('fixed', 'name', 'left(obs, 60)')}
WHEN 1 THEN {_sql_said('multi')} || {_RAN('bad', 'err')} || {_sql_said('multi_found', 'name')} || {_RAN('code', 'obs')} || {_sql_said('multi_fixed', 'name', 'left(obs, 60)')} WHEN 2 THEN NULL
WHEN 3 THEN {_sql_said('benchmark', 'f')} || {_RAN('tested', 'obs')} || {_sql_said('benchmark_critique')} || {_sql_said('benchmark_done', 'code')}
WHEN 4 THEN {_sql_said('tdd')} || {_RAN('tested', 'err')} || {_sql_said('tdd_next')} || {_RAN('code', 'obs')} || {_sql_said('tdd_done', 'code')}
ELSE {_sql_said('refactor')} || {_RAN('bad', 'obs')} || {_sql_said('refactor_next')} || {_RAN('code', 'obs')} || {_sql_said('refactored', 'left(obs, 50)', 'code')} END) AS trace_md5 FROM n""")
def trajectory_fixes(t):
    """A trace of one of six kinds for each document, whose text is what its code prints: fixes in one and two steps, one
    that is no change, a benchmark's, tests first, and a refactoring."""
    u = F.pmod(F.conv(F.substr(F.md5(F.concat(F.lit("trace:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(6))
    n, obs = F.col("doc_id").cast("string"), F.col("text")
    code = F.concat(F.lit("def f"), n, F.lit("():\n    return "), F.length(obs).cast("string"))
    bad, err, yes = F.replace(code, F.lit("():"), F.lit("()")), F.concat(F.lit("ERROR: "), F.left(obs, F.lit(40))), F.lit(True)
    name = F.when(u % 2 == 0, "SyntaxError (missing colon)").otherwise("NameError")
    tested = F.concat(code, F.lit("\nassert f"), n, F.lit("()"))
    made = [fix_trace(bad, err, code, obs, name), multi_fix_trace(bad, err, F.lit(False), code, obs, name), multi_fix_trace(code, err, F.lit(False), code, obs, name), benchmark_trace(tested, obs, yes), tdd_trace(tested, err, code, obs, yes), refactor_trace(bad, obs, yes, code, obs, yes)]
    out = F.when(u == 0, made[0])
    for k, x in enumerate(made[1:], 1):
        out = out.when(u == k, x)
    return t.documents.select("doc_id", F.md5(out.cast("binary")).alias("trace_md5"))


_U = "cast(('0x' || substr(md5('mix:' || doc_id), 1, 8)) AS BIGINT)::DOUBLE / 4294967296"
#: Kinds of traces, and where each ends on a uniform draw.
MIXTURE = [("benchmark", 0.05), ("tdd", 0.13), ("refactor", 0.21), ("write_verify", 0.43), ("fix_multi", 0.65)]


@query("mixture_case", f"SELECT doc_id, CASE {' '.join(f'WHEN u < {x} THEN {chr(39)}{k}{chr(39)}' for k, x in MIXTURE)} ELSE 'fix_single' END AS kind FROM (SELECT doc_id, {_U} AS u FROM documents)")
def mixture_case(t):
    u = F.conv(F.substr(F.md5(F.concat(F.lit("mix:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296
    out = F.when(u < MIXTURE[0][1], MIXTURE[0][0])
    for k, x in MIXTURE[1:]:
        out = out.when(u < x, k)
    return t.documents.select("doc_id", out.otherwise("fix_single").alias("kind"))


def trace_types(df: DataFrame) -> DataFrame:
    """Counts of kinds of examples, which may overlap, by what they say."""
    i, r = F.col("instruction"), F.col("response")
    says = lambda c, w: F.contains(c, F.lit(w))
    plain = says(F.lower(r), "verified") & ~says(F.lower(i), "bug") & ~says(i, "TDD") & ~says(i, "Refactor")
    kinds = {"write_verify": plain, "tdd": says(i, "TDD") | says(F.lower(r), "test first"), "refactor": says(i, "Refactor"), "fix_single": says(i, "has a bug"), "fix_multi": says(i, "it errors")}
    return df.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


_TOLD = "CASE doc_id % 5 WHEN 0 THEN 'TDD: do it' WHEN 1 THEN 'Refactor it' WHEN 2 THEN 'it has a bug' WHEN 3 THEN 'it errors' ELSE 'do it' END"
_SAID = "CASE doc_id % 3 WHEN 0 THEN 'Verified.' WHEN 1 THEN 'Test first' ELSE 'x' END"


@query("trace_types", f"SELECT count_if(contains(lower(r), 'verified') AND NOT contains(lower(i), 'bug') AND NOT contains(i, 'TDD') AND NOT contains(i, 'Refactor'))::BIGINT AS write_verify, count_if(contains(i, 'TDD') OR contains(lower(r), 'test first'))::BIGINT AS tdd, count_if(contains(i, 'Refactor'))::BIGINT AS refactor, count_if(contains(i, 'has a bug'))::BIGINT AS fix_single, count_if(contains(i, 'it errors'))::BIGINT AS fix_multi FROM (SELECT {_TOLD} AS i, {_SAID} AS r FROM documents)")
def trace_types_query(t):
    return trace_types(t.documents.select(F.expr(_TOLD).alias("instruction"), F.expr(_SAID).alias("response")))


# --- bug injection: Column -> Column; which line a random one takes is chosen by a hash of key ---


def _pick(found: Column, key: Column) -> Column:
    """One of the line numbers in found, by key; null if there is none."""
    return F.when(F.size(found) > 0, F.get(found, F.pmod(F.xxhash64(key), F.size(found)).cast("int")))


def _change(code: Column, key: Column, wanted, change) -> Column:
    """code with change made to one line, chosen by key among those that are wanted (line, number)."""
    rows = P.lines(code)
    at = _pick(F.filter(F.transform(rows, lambda x, i: F.when(wanted(x, i), i)), lambda i: i.isNotNull()), key)
    return F.when(at.isNull(), code).otherwise(F.array_join(F.transform(rows, lambda x, i: F.when(i == at, change(x)).otherwise(x)), "\n"))


def missing_colon(code: Column, key: Column) -> Column:
    opens = r"^\s*(def |if |for |while |else|elif |with |class |try|except).*:\s*$"
    return _change(code, key, lambda x, _: F.regexp_like(x, F.lit(opens)), lambda x: F.regexp_replace(x, r":\s*$", ""))


def name_error(code: Column, key: Column) -> Column:
    """The first indented assignment to a name of three letters or more gets another name."""
    rows = P.lines(code)
    name = lambda x: F.regexp_extract(x, r"^\s+(\w+)\s*=\s*", 1)
    fits = F.transform(rows, lambda x: (F.length(name(x)) > 2) & ~name(x).isin("True", "False", "None", "self"))
    at = F.array_position(fits, True) - 1
    return F.when(at < 0, code).otherwise(F.array_join(F.transform(rows, lambda x, i: F.when(i == at, F.regexp_replace(x, r"^(\s+\w+)", "$1_bad")).otherwise(x)), "\n"))


def off_by_one(code: Column, key: Column) -> Column:
    return _first(code, "range(", "range(1 + ")


def type_error(code: Column, key: Column) -> Column:
    at = F.regexp_instr(code, F.lit(r"\b[2-9]\b"))
    return F.when(at > 0, F.concat(F.substr(code, F.lit(1), at - 1), F.lit('"'), F.substr(code, at, F.lit(1)), F.lit('"'), F.substr(code, at + 1))).otherwise(code)


def _first(code: Column, old: str, new: str) -> Column:
    at = F.instr(code, F.lit(old))
    return F.when(at > 0, F.concat(F.substr(code, F.lit(1), at - 1), F.lit(new), F.substr(code, at + len(old)))).otherwise(code)


#: Operators and what they are swapped for.
SWAPS = [("==", "!="), ("<=", ">"), (">=", "<"), ("< 2", "< 1"), ("+ 1", "- 1"), ("- 1", "+ 1")]


def wrong_operator(code: Column, key: Column) -> Column:
    """One of the swaps that fit, chosen by key, made once."""
    made = F.filter(F.array(*[F.when(F.contains(code, F.lit(a)), _first(code, a, b)) for a, b in SWAPS]), lambda x: x.isNotNull())
    return F.coalesce(_pick(made, key), code)


def wrong_return(code: Column, key: Column) -> Column:
    return _change(code, key, lambda x, _: F.regexp_like(x, F.lit(r"^\s*return ")), lambda x: F.regexp_replace(x, r"^(\s*)return ", "$1return None  # was: "))


def indent_error(code: Column, key: Column) -> Column:
    wanted = lambda x, i: F.startswith(x, F.lit("    ")) & ~F.startswith(F.ltrim(x), F.lit("#")) & (i > 0)
    return _change(code, key, wanted, lambda x: F.ltrim(x, F.lit(P.WHITE)))


INJECTORS = {"SyntaxError (missing colon)": missing_colon, "NameError (typo in variable)": name_error, "LogicError (wrong operator)": wrong_operator, "TypeError (string vs int)": type_error, "LogicError (wrong return)": wrong_return, "IndentationError": indent_error}


@query("inject_bug")
def inject_bug(t):
    """Each document's little function with each bug; bugs that change nothing are left out."""
    n = F.col("doc_id").cast("string")
    code = F.concat(F.lit("def f(x):\n    total = "), n, F.lit(" + 1\n    for i in range(7):\n        total = total + i\n    return total"))
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("bug"), f(F.col("code"), F.col("doc_id")).alias("buggy")) for k, f in INJECTORS.items()]))
    return t.documents.select("doc_id", code.alias("code")).select("doc_id", "code", made.alias("b")).where("b.buggy <> code").select("doc_id", "b.bug", "b.buggy")


# --- patches and searches ---

_PATCH = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) WHEN 2 THEN 'so: diff --git a/x b/x ' || lang || ' ' ELSE left(text, 50) END"
_STATUS = "CASE WHEN trim(p, ' ' || chr(10)) = '' THEN 'empty patch' WHEN contains(p, 'diff --git') OR contains(p, '---') THEN 'patch with diff' ELSE 'non-empty patch (no diff header)' END"


@query("patch_status", f"SELECT doc_id, {_STATUS} AS status FROM (SELECT doc_id, {_PATCH} AS p FROM documents)")
def patch_status(t):
    return t.documents.select("doc_id", P.patch_status(F.expr(_PATCH)).alias("status"))


@query("patch_extract", f"SELECT doc_id, CASE WHEN contains(p, 'diff --git') THEN trim(substr(p, instr(p, 'diff --git')), ' ' || chr(10)) ELSE '' END AS patch, left(text, 3000) = text AS whole_issue FROM (SELECT doc_id, text, {_PATCH} AS p FROM documents)")
def patch_extract(t):
    return t.documents.select("doc_id", P.extract_patch(F.expr(_PATCH)).alias("patch"), (F.left("text", F.lit(3000)) == F.col("text")).alias("whole_issue"))


@query("swe_totals", f"SELECT count_if({_STATUS} = 'patch with diff')::BIGINT AS with_diff, count(*) AS n, sum(doc_id % 7)::BIGINT AS tool_calls, sum(doc_id % 3)::BIGINT AS continuations FROM (SELECT doc_id, {_PATCH} AS p FROM documents)")
def swe_totals(t):
    return t.documents.agg(F.count_if(P.patch_status(F.expr(_PATCH)) == "patch with diff").alias("with_diff"), F.count("*").alias("n"), F.sum(F.col("doc_id") % 7).alias("tool_calls"), F.sum(F.col("doc_id") % 3).alias("continuations"))


_FOUND = "'src/a' || (doc_id % 3) || '.py:1: x' || chr(10) || '/abs.py:2: y' || chr(10) || 'none' || chr(10) || ' b.py :3: z' || chr(10) || 'src/a' || (doc_id % 2) || '.py:4: x' || chr(10) || lang || ':5:' || chr(10) || 'e:1' || chr(10) || 'f:1' || chr(10) || 'g:1'"


@query("first_paths", f"WITH l AS (SELECT doc_id, unnest(string_split(f, chr(10))) AS line, generate_subscripts(string_split(f, chr(10)), 1) AS i FROM (SELECT doc_id, {_FOUND} AS f FROM documents)), p AS (SELECT doc_id, trim(split_part(line, ':', 1)) AS path, min(i) AS i FROM l WHERE contains(line, ':') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM p WHERE path <> '' AND NOT starts_with(path, '/')) SELECT doc_id, string_agg(path, ',' ORDER BY i) AS paths FROM r WHERE r <= 5 GROUP BY 1")
def first_paths(t):
    return t.documents.select("doc_id", F.array_join(P.first_paths(F.expr(_FOUND)), ",").alias("paths"))


@query("context_nudge", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'diff' WHEN doc_id % 6 = 1 THEN 'write' WHEN doc_id % 6 = 2 THEN 'retry_read' WHEN doc_id % 6 IN (3, 4) THEN 'read' ELSE 'search' END AS nudge FROM documents")
def context_nudge(t):
    """What a run without a patch is told next, by the tools that it used: (tool, ok) in its log."""
    n = F.col("doc_id") % 6
    entry = lambda tool, ok: F.array(F.struct(F.lit(tool).alias("tool"), F.lit(ok).alias("ok")))
    log = F.when(n == 0, F.concat(entry("read_file", True), entry("write_file", True))).when(n == 1, F.concat(entry("read_file", False), entry("read_file", True))).when(n == 2, F.concat(entry("search_code", True), entry("read_file", False)))
    log = log.when(n == 3, entry("search_code", True)).when(n == 4, entry("list_files", True)).otherwise(entry("write_file", False))
    return t.documents.select("doc_id", nudge(log).alias("nudge"))


def nudge(log: Column) -> Column:
    used = lambda tool, ok: F.exists(log, lambda e: (e["tool"] == tool) & (e["ok"] == ok))
    searched = used("search_code", True) | used("list_files", True)
    return F.when(used("write_file", True), "diff").when(used("read_file", True), "write").when(used("read_file", False), "retry_read").when(searched, "read").otherwise("search")


@query("grep_limit", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, i AS line_no, line FROM l WHERE regexp_matches(line, 'tion') ORDER BY doc_id, i LIMIT 50")
def grep_limit(t):
    """The first 50 lines that match, in order: each task keeps its own first 50."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike("tion"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line").orderBy("doc_id", "line_no").limit(50)


@query("fmt_margin", "SELECT doc_id, printf('%.4f', q) AS top1, CASE WHEN q - 0.5 < 0 THEN '-' ELSE '+' END || printf('%.4f', abs(q - 0.5)) AS margin, '±' || printf('%.1f', round_even(q * 100, 1)) || ' pp' AS pp FROM (SELECT doc_id, (doc_id % 1000) / 1000.0::DOUBLE AS q FROM documents)")
def fmt_margin(t):
    """Scores with four digits, margins with a sign; rounded half-even before they are printed."""
    q = (F.col("doc_id") % 1000) / F.lit(1000.0)
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.bround(c, n))
    return t.documents.select("doc_id", fixed(q, 4).alias("top1"), F.concat(F.when(q - 0.5 < 0, "-").otherwise("+"), fixed(F.abs(q - 0.5), 4)).alias("margin"), F.concat(F.lit("±"), fixed(q * 100, 1), F.lit(" pp")).alias("pp"))


# --- scores of answers ---

#: Questions on an image, with the words that an answer must hold one of.
QUESTIONS = {"colour": ["red", "blue", "rel"], "shape": ["div", "circle"], "what": ["article", "figure"]}


def ngrams(tokens: Column, n: int) -> Column:
    size = F.size(tokens) - n + 1
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.slice(tokens, 1, 0))


def clipped_precision(candidate: Column, reference: Column, n: int) -> Column:
    """Share of the candidate's n-grams that the reference has, each as often as it has it; 0 without any. For short
    answers: the time grows with the product of the lengths."""
    low = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    a, b = ngrams(low(candidate), n), ngrams(low(reference), n)
    often = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(often(a, x), often(b, x)))
    return F.when(F.size(a) > 0, shared / F.size(a)).otherwise(0.0)


def long_precision(df: DataFrame, key: str, candidate: Column, reference: Column, n: int) -> DataFrame:
    """(key, p) of each row: the same of texts of any length, whose words lie between the white space that the SQL knows. A
    row's n-grams are counted in the task that reads it; those of keys with several rows, which count together, meet by gram."""
    low = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\n\f\r]+"), lambda x: x != "")
    precision = lambda shared, total: F.when(total > 0, shared / total).otherwise(0.0).alias("p")

    def in_tasks(rows):
        both = rows.select(F.col(key).alias("id"), F.concat(low(candidate), F.array(F.lit("")), low(reference)).alias("ws"))
        return common_grams(both, n).select(F.col("id").alias(key), precision(F.col("shared"), F.col("total")))

    several = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    if several.isEmpty():
        return in_tasks(df)
    same = F.col(key).eqNullSafe(F.col("_key"))
    # Words are joined with those that follow by zips of shifted arrays: an array inside a lambda is made anew each time.
    shifted = lambda xs, i: F.slice(xs, i + 1, F.greatest(F.size(xs) - i, F.lit(0)))
    runs = lambda xs: reduce(lambda a, i: F.zip_with(a, shifted(xs, i), lambda x, y: F.concat(x, F.lit(" "), y)), range(1, n), xs)
    told = lambda c, own: F.transform(F.filter(runs(low(c)), lambda x: x.isNotNull()), lambda x: F.struct(x.alias("gram"), F.lit(own).alias("own")))
    grams = df.join(several, same, "left_semi").select(key, F.explode_outer(F.concat(told(candidate, True), told(reference, False))).alias("_x")).select(key, "_x.*")
    each = grams.groupBy(key, "gram").agg(F.count_if("own").alias("a"), F.count_if(~F.col("own")).alias("b"))
    together = each.groupBy(key).agg(precision(F.sum(F.least("a", "b")), F.sum("a")))
    of_rows = together.join(several, same).select(key, "p", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(key, "p")
    return in_tasks(df.join(several, same, "left_anti")).unionByName(of_rows)


_IMAGES = "SELECT page_id, html FROM (SELECT page_id, html, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS r FROM pages) WHERE r <= 10"


@query("cross_score", f"WITH i AS ({_IMAGES}), q AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', [{', '.join(chr(39) + w + chr(39) for w in ws)}])" for k, ws in QUESTIONS.items()) + ") AS v(q, ws)), w AS (SELECT page_id, unnest(string_split(regexp_replace(lower(left(html, 400)), '\\s+', ' ', 'g'), ' ')) AS w FROM i), c AS (SELECT page_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY page_id) AS total FROM w WHERE w <> '' GROUP BY 1, 2), s AS (SELECT page_id, q, list_bool_or(list_transform(ws, lambda k: contains(lower(left(html, 400)), k))) AS hit, ws FROM i, q), o AS (SELECT s.page_id, s.q, any_value(hit) AS hit, coalesce(sum(least(n, 1)) FILTER (list_contains(ws, w)), 0)::DOUBLE / max(total) AS overlap FROM s JOIN c USING (page_id) GROUP BY 1, 2) SELECT round(avg(hit::INT), 6) AS score, round(avg(overlap), 6) AS overlap, count(*) AS pairs FROM o")
def cross_score(t):
    """Hits and mean unigram overlap over all pairs of at most ten images of each kind and the questions."""
    from pyspark.sql import Window as W

    kind = F.col("page_id") % 3
    images = t.pages.withColumn("r", F.row_number().over(W.partitionBy(kind).orderBy("page_id"))).where("r <= 10")
    asked = F.explode(F.array(*[F.array(*map(F.lit, ws)) for ws in QUESTIONS.values()])).alias("words")
    pairs = images.select(F.left("html", F.lit(400)).alias("answer"), asked)
    hit = F.exists("words", lambda w: F.contains(F.lower("answer"), F.lower(w)))
    return pairs.agg(F.round(F.avg(hit.cast("int")), 6).alias("score"), F.round(F.avg(clipped_precision(F.col("answer"), F.array_join("words", " "), 1)), 6).alias("overlap"), F.count("*").alias("pairs"))


_BIGRAMS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"


@query("bigram_precision", f"WITH d AS (SELECT a.doc_id, list_filter(string_split(regexp_replace(lower(a.text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w, list_filter(string_split(regexp_replace(lower(left(a.text, length(a.text) // 2)) || ' of the', '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS v FROM documents a), g AS (SELECT doc_id, unnest({_BIGRAMS}) AS x FROM d), h AS (SELECT doc_id, unnest({_BIGRAMS.replace('w[', 'v[').replace('(w)', '(v)')}) AS x FROM d), c AS (SELECT doc_id, x, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT doc_id, x, count(*) AS m FROM h GROUP BY 1, 2) SELECT d.doc_id, coalesce(round(p, 6), 0) AS p FROM d LEFT JOIN (SELECT c.doc_id, sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n) AS p FROM c LEFT JOIN r USING (doc_id, x) GROUP BY 1) USING (doc_id)")
def bigram_precision(t):
    """Clipped bigram precision of each text against its first half with two more words."""
    reference = F.concat(F.left("text", F.floor(F.length("text") / 2).cast("int")), F.lit(" of the"))
    # As in the SQL: no id equals null, and ties are those of the product (323 / 640 goes down).
    p = F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.round(F.col("p") * 1e6) / 1e6)
    return long_precision(t.documents, "doc_id", F.col("text"), reference, 2).select("doc_id", p.alias("p"))


@query("sample_with_replacement", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), d AS (SELECT k, cast('0x' || substr(md5('draw:' || k), 1, 8) AS BIGINT) AS h FROM range(500) AS r(k)) SELECT k AS draw, doc_id FROM d JOIN p ON h % n = i")
def sample_with_replacement(t):
    """500 draws by hash from the documents in the order of their ids; only the draws' places are joined."""
    from .sequence import global_index

    pool = global_index(t.documents.select("doc_id"), "doc_id", "i")
    n = t.documents.agg(F.count("*").alias("n"))
    h = F.conv(F.substr(F.md5(F.concat(F.lit("draw:"), F.col("id").cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    draws = t.spark.range(500).crossJoin(F.broadcast(n)).select(F.col("id").alias("draw"), F.pmod(h, F.col("n")).alias("i"))  # n is one row
    return draws.join(pool, "i").select("draw", "doc_id")


@query("tfidf_weights", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
f AS (SELECT term, count(*) + 1 AS df FROM c GROUP BY 1), n AS (SELECT count(*) + 1 AS n FROM documents), v AS (SELECT doc_id, tf * (ln((n + 1)::DOUBLE / df) + 1) AS x FROM c JOIN f USING (term), n)
SELECT doc_id, round(max(x), 6) AS top, round(sum(x), 4) AS total, count(*) AS terms FROM v GROUP BY 1""")
def tfidf_weights(t):
    """Weights of each text's words with the text itself as the query: N and df are one more than in the store."""
    n = t.documents.count() + 1
    w = sums(t.documents, "doc_id", "text", lambda df, log: log((n + 1.0) / (df + 1)) + 1, bigrams=False)
    return w.select("doc_id", F.round("top", 6).alias("top"), F.round("total", 4).alias("total"), "terms")
