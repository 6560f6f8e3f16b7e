"""Column functions on agent transcripts: markers at line starts, observations, calls, code, audits. All built in.

A line ends at a line feed. Patterns say (?d), so that no other character counts as a line end in them.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
#: Tools that an agent may call when it is evaluated, trained on, or generated for.
EVALUATED_TOOLS = "execute_code run_script run_tests read_file write_file install_package check_syntax git_commit git_push git_log git_diff git_status".split()
TRAINED_TOOLS = "execute_code run_script run_tests read_file write_file edit_file search_file list_files run_command check_syntax run_linter install_package format_code git_status git_diff git_log".split()
GENERATED_TOOLS = "execute_code run_script run_tests read_file write_file install_package check_syntax format_code run_linter list_files search_file edit_file git_commit git_push git_log git_diff git_status".split()
#: Markers that no stored call, and no prompt of an evaluated text, may hold.
BANNED = ["VALID:", "DIFFERENT_CORRECTED_TOOL_CALL", "Revised TOOL_CALL:", '"""', "```"]
BANNED_IN_RECORDS = ["VALID:", "DIFFERENT_CORRECTED_TOOL_CALL", '"""']
PROMPT_MARKERS = ["<|im_start|>system", "<|im_start|>user", "Rules:", "Protocol:"]
PRIORITY_TASKS = "word_count lru_cache graph_bfs roman_numerals merge_sorted fizzbuzz factorial unique_sorted".split()

OBSERVED = r"(?ds)\nOBSERVATION:.*?(?=\n(?:<think>|TOOL_CALL:|CRITIQUE:|FINAL_ANSWER:)|\z)"
OBSERVED_BLOCK = r"(?dms)^OBSERVATION:.*?(?=^(?:TOOL_CALL|FIXED|CRITIQUE|FINAL_ANSWER|OBSERVATION):|\z)"
CALL_NAME = r"(?dm)^TOOL_CALL:\s*(\w+)\s*\("
PASSED = r"(?dm)^OBSERVATION:\s*PASS\b"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip_observations(text: Column) -> Column:
    """The text without observations, each with the line end before it and up to the agent's next line."""
    return F.regexp_replace(text, OBSERVED, "")


def strip_runtime(text: Column) -> Column:
    """The text without observations and what else the runtime put in: hints and debug lines; stripped."""
    for pattern in (OBSERVED_BLOCK, r"\[SYSTEM HINT:[^\]]*\]", r"\[DEBUG\][^\n]*", r"(?dm)^RUNTIME-INJECTED[^\n]*"):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def segments(text: Column) -> Column:
    """Structs (text, supervised) that joined are the text: observations aren't supervised, empty ones are left out."""
    own, seen = F.split(text, OBSERVED, -1), F.regexp_extract_all(text, F.lit(OBSERVED), F.lit(0))
    kind = lambda x, flag: F.struct(x.alias("text"), F.lit(flag).alias("supervised"))
    both = F.flatten(F.transform(own, lambda x, i: F.array(kind(x, True), kind(F.coalesce(F.get(seen, i), F.lit("")), False))))
    out = F.filter(both, lambda s: s["text"] != "")
    return F.when(F.size(out) > 0, out).otherwise(F.array(kind(text, True)))


def first_line_type(text: Column) -> Column:
    line = F.get(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(0))
    marks = [F.when(F.startswith(line, F.lit(f"{m}:")), m) for m in ("TOOL_CALL", "CRITIQUE", "FINAL_ANSWER")]
    return F.coalesce(*marks, F.lit("other"))


def final_answer(text: Column) -> Column:
    """The first line that is a final answer, trimmed; empty if there is none."""
    found = F.filter(F.transform(lines(text), strip), lambda x: F.startswith(x, F.lit("FINAL_ANSWER:")))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def called_names(text: Column, at_line_start: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(CALL_NAME if at_line_start else r"TOOL_CALL:\s*(\w+)\s*\("), F.lit(1))


def invalid_tools(text: Column, allowed: list[str]) -> Column:
    """Names of calls that aren't allowed, in order, as often as they occur."""
    return F.filter(called_names(text, False), lambda n: ~n.isin(*allowed))


def direct_call(text: Column, allowed: list[str] = EVALUATED_TOOLS) -> Column:
    return F.exists(called_names(text), lambda n: ~n.isin(*allowed))


def repeats(items: Column) -> Column:
    """How many items equal an earlier one."""
    return F.size(items) - F.size(F.array_distinct(items))


def first_exception(observations: Column) -> Column:
    """The first exception named in an observation that has ERROR; empty if there is none."""
    named = F.transform(F.filter(observations, lambda o: F.contains(o, F.lit("ERROR"))), lambda o: F.regexp_extract(o, r"(\w+Error|\w+Exception):", 1))
    return F.coalesce(F.get(F.filter(named, lambda n: n != ""), F.lit(0)), F.lit(""))


def present(text: Column, markers: list[str]) -> Column:
    """Those of markers that the text holds."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def has_any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def guarded(text: Column, markers: list[str] = PROMPT_MARKERS) -> Column:
    """The text; an error if it holds a marker of the prompt."""
    found = F.get(present(text, markers), F.lit(0))
    return F.when(found.isNotNull(), F.raise_error(F.concat(F.lit("prompt marker in generated text: "), found)).cast("string")).otherwise(text)


def passes(observations: Column) -> Column:
    """Whether an observation says PASS and names neither a traceback nor an error."""
    fine = lambda o: F.contains(o, F.lit("PASS")) & ~F.contains(o, F.lit("Traceback")) & ~F.contains(o, F.lit("Error"))
    return F.exists(observations, fine)


def critique_flags(critique: Column) -> tuple[Column, Column, Column]:
    """(is there one, does it want a fix, does it call the solution fine)"""
    low = F.lower(critique)
    return strip(critique) != "", F.contains(low, F.lit("fix needed")), F.contains(low, F.lit("→ solution ok"))


def failure_type(invalid_json: Column, no_output: Column, indentation: Column, exception: Column, errors: Column) -> Column:
    """Why a run didn't pass at once, from the text columns of an evaluation file."""
    return (
        F.when(invalid_json == "True", "invalid_json")
        .when(whole(no_output) > 0, "no_output")
        .when(indentation == "True", "indentation_error")
        .when(exception == "SyntaxError", "syntax_error")
        .when(whole(errors) > 0, "assertion_error")
        .otherwise("none")
    )


def memory_category(task: Column, failure: Column, errors: Column) -> Column:
    return (
        F.when(task.isin(*PRIORITY_TASKS), "task_specific_success")
        .when(failure == "no_output", "no_output_to_pass")
        .when(failure == "invalid_json", "invalid_json_to_valid_json")
        .when(failure == "assertion_error", "assertion_error_to_correct_assert")
        .when(whole(errors) > 0, "failure_to_fix")
        .otherwise("verified_success")
    )


def whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def reject_reason(row, least: str = "verified_tool") -> Column:
    """Why a row of an evaluation file isn't taken, the first that holds; empty if it is. row: name -> text column."""
    mode = F.coalesce(row("scoring_mode"), F.lit(""))
    unverified = (mode != "") & ~F.contains(mode, F.lit("verified")) & F.lit(least == "verified_tool")
    return (
        F.when(~row("passed").eqNullSafe("True"), "passed!=True")
        .when(~row("passed_via_tool").eqNullSafe("True"), "passed_via_tool!=True")
        .when(row("used_fallback_extraction").eqNullSafe("True"), "used_fallback_extraction==True")
        .when(unverified, F.concat(F.lit("scoring_mode='"), mode, F.lit("' not verified")))
        .when(F.coalesce(row("full_transcript"), F.lit("")) == "", "empty full_transcript")
        .otherwise("")
    )


def is_recovery(instruction: Column, response: Column) -> Column:
    """Whether an example shows a failure that is put right."""
    inline = F.regexp_like(response, F.lit(r"(?s)OBSERVATION:.*?ERROR")) & F.contains(response, F.lit("OBSERVATION: PASS"))
    return F.contains(instruction, F.lit("OBSERVATION:")) | inline


def observation_leak(text: Column) -> Column:
    """Whether an observation says what no runtime says: neither PASS, ERROR, (no output) nor (none)."""
    return F.regexp_like(text, F.lit(r"(?dm)^OBSERVATION: (?!PASS\b)(?!ERROR\b)(?!\(no output\))(?!\(none\))"))


def patch_status(patch: Column) -> Column:
    diff = F.contains(patch, F.lit("diff --git")) | F.contains(patch, F.lit("---"))
    return F.when(strip(patch) == "", "empty patch").when(diff, "patch with diff").otherwise("non-empty patch (no diff header)")


def extract_patch(text: Column) -> Column:
    """From the first diff header on, stripped; empty if there is none."""
    at = F.instr(text, F.lit("diff --git"))
    return F.when(at > 0, strip(F.substr(text, at))).otherwise("")


def first_paths(found: Column, most: int = 5) -> Column:
    """The first paths, each once, of lines file:line: text; absolute ones don't count."""
    named = F.filter(lines(found), lambda x: F.contains(x, F.lit(":")))
    paths = F.filter(F.transform(named, lambda x: strip(F.substring_index(x, ":", 1))), lambda p: (p != "") & ~F.startswith(p, F.lit("/")))
    return F.slice(F.array_distinct(paths), 1, most)


def char_decode(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda x: F.chr(F.least(x, F.lit(127)))), "")


def last_block(text: Column, fence: str) -> Column:
    """The last fenced block, stripped; empty if there is none."""
    found = F.regexp_extract_all(text, F.lit(fence), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1))).otherwise("")


PYTHON_FENCE, ANY_FENCE = r"(?is)```python\s*(.*?)```", r"(?s)```\s*(.*?)```"


def extract_code(text: Column, statement_lines) -> Column:
    """The best code of a response: the last Python fence of its last answer or fix, the last one at all, then any
    fence of the same two, a RUN_CODE block, and at last its lines that look like statements."""
    clean = strip_runtime(text)
    after = lambda m: F.element_at(F.split(clean, m), -1)
    answer, fix = F.contains(clean, F.lit("FINAL_ANSWER:")), F.contains(clean, F.lit("FIXED:"))
    preferred = F.when(answer, after("FINAL_ANSWER:")).when(fix, after("FIXED:")).otherwise("")
    run = r"(?s)RUN_CODE:\s*(.*?)(?:\n(?:OBSERVATION|CRITIQUE|FINAL_ANSWER|TOOL_CALL):|\z)"
    fenced = [F.nullif(last_block(x, f), F.lit("")) for f in (PYTHON_FENCE, ANY_FENCE) for x in (preferred, clean)]
    block = F.when(F.contains(clean, F.lit("RUN_CODE:")), strip(F.regexp_extract(clean, run, 1)))
    return F.coalesce(*fenced, block, statement_lines(clean))


#: An observation, wherever it begins, up to the agent's next line.
_SEEN = r"(?s)OBSERVATION:\s*(.*?)(?=\nTOOL_CALL:|\nCRITIQUE:|\nFINAL_ANSWER:|\z)"


def approves_after_error(text: Column) -> Column:
    """Whether the solution is called fine after a failed observation with no passing one between them."""
    seen, after = F.regexp_extract_all(text, F.lit(_SEEN), F.lit(1)), F.split(text, _SEEN, -1)
    events = F.transform(seen, lambda x, i: F.struct(strip(x).alias("obs"), F.lower(F.concat(x, F.lit("\n"), F.coalesce(F.get(after, i + 1), F.lit("")))).alias("until")))

    def step(s: Column, x: Column) -> Column:
        error = F.contains(x["obs"], F.lit("Error")) | F.contains(x["obs"], F.lit("ERROR"))
        failed = F.when(F.startswith(x["obs"], F.lit("PASS")), False).when(error, True).otherwise(s["failed"])
        return F.struct(failed.alias("failed"), (s["bad"] | (failed & F.contains(x["until"], F.lit("→ solution ok")))).alias("bad"))

    start = F.struct(F.lit(False).alias("failed"), F.lit(False).alias("bad"))
    return F.aggregate(events, start, step, lambda s: s["bad"])


def repeats_call_after_error(text: Column) -> Column:
    """Whether a call line comes again as the next call after its observation failed."""
    start = F.struct(F.lit("").alias("call"), F.lit(False).alias("failed"), F.lit(False).alias("open"), F.lit(False).alias("bad"))

    def step(s: Column, x: Column) -> Column:
        call = F.startswith(x, F.lit("TOOL_CALL:")) & (F.length(x) > 10)
        observed = F.startswith(x, F.lit("OBSERVATION:"))
        closes = F.startswith(x, F.lit("TOOL_CALL:")) | F.startswith(x, F.lit("CRITIQUE:")) | F.startswith(x, F.lit("FINAL_ANSWER:"))
        error = F.contains(x, F.lit("Error")) | F.contains(x, F.lit("ERROR"))
        inside = s["open"] & ~closes
        failed = F.when(call, False).when(inside, s["failed"] | error).when(observed, error).otherwise(s["failed"])
        return F.struct(
            F.when(call, strip(x)).otherwise(s["call"]).alias("call"),
            failed.alias("failed"),
            F.when(closes, False).when(observed, True).otherwise(s["open"]).alias("open"),
            (s["bad"] | (call & s["failed"] & (strip(x) == s["call"]))).alias("bad"),
        )

    return F.aggregate(lines(text), start, step, lambda s: s["bad"])


# The names of issues in response_issues and the messages of record_errors must read exactly as they do.


def response_issues(text: Column, scanned: Column, allowed: list[str] = GENERATED_TOOLS) -> Column:
    """All issues of a response: scanned has those that need a scanner."""
    unknown = F.transform(F.filter(called_names(text), lambda n: ~n.isin(*allowed)), lambda n: F.concat(F.lit("unknown tool '"), n, F.lit("'")))
    passed, answer = F.regexp_instr(text, F.lit(PASSED)), F.regexp_instr(text, F.lit(r"(?dm)^FINAL_ANSWER:"))
    critique = F.instr(text, F.lit("CRITIQUE:"))
    before = F.when(critique > 1, F.substr(text, F.lit(1), critique - 1)).otherwise("")
    recovering = (first_line_type(text) == "CRITIQUE") | F.regexp_like(before, F.lit("OBSERVATION:.*(?:ERROR|no output)"))
    found = [
        F.when(F.regexp_like(text, F.lit(r'execute_code\s*\(\s*\{[^}]*"""')), "triple_quoted_string_in_execute_code_args"),
        F.when((answer > 0) & (passed == 0), "final_answer_without_pass"),
        F.when((answer > 0) & (passed > 0) & (answer < passed), "final_answer_before_pass"),
        F.when((passed > 0) & F.contains(F.substr(text, F.greatest(passed, F.lit(1))), F.lit("\nTOOL_CALL:")), "tool_call_after_pass"),
        F.when(approves_after_error(text), "solution_ok_after_error_before_pass"),
        F.when(repeats_call_after_error(text), "repeated_identical_tool_call_after_error"),
        *[F.when(F.contains(text, F.lit(m)), f"bad_marker {m}") for m in ("VALID:", "DIFFERENT_CORRECTED_TOOL_CALL", "```")],
        F.when(recovering & ~F.contains(text, F.lit("OBSERVATION: PASS")), "recovery_response_never_reaches_pass"),
    ]
    return F.concat(unknown, scanned, F.array_compact(F.array(*found)))


REQUIRED = ["id", "task", "category", "query_text", "corrected_tool_call", "observation", "verified", "created_at", "content_hash"]


def record_errors(row, state: Column) -> Column:
    """What is wrong with a memory record, in order. row: name -> column; state: what its call's scanner found."""
    call = F.coalesce(row("corrected_tool_call"), F.lit(""))
    found = [F.when(row(c).isNull(), f"missing required field: '{c}'") for c in REQUIRED]
    found += [
        F.when(~F.coalesce(row("verified"), F.lit(False)), "verified must be True"),
        F.when(~F.contains(F.coalesce(row("observation"), F.lit("")), F.lit("PASS")), "observation must contain 'PASS'"),
        F.when(~F.startswith(strip(call), F.lit("TOOL_CALL: execute_code(")), "corrected_tool_call must start with 'TOOL_CALL: execute_code('"),
    ]
    for c in ("corrected_tool_call", "final_answer"):
        text = F.coalesce(row(c), F.lit(""))
        found.append(F.when(F.contains(text, F.lit("```")), f"{c}: markdown code fences (```) not allowed"))
        found += [F.when(F.contains(text, F.lit(m)), f"{c}: banned marker '{m}'") for m in BANNED_IN_RECORDS]
    found += [
        F.when(state == "unmatched", "corrected_tool_call: unmatched parenthesis"),
        F.when(state == "invalid", "corrected_tool_call: invalid JSON in args"),
        F.when(state == "no_code", "corrected_tool_call: args missing 'code' key"),
    ]
    return F.array_compact(F.array(*found))
