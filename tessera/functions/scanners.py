"""Scanners of tool calls: what quotes, brackets, strict JSON and Python syntax need, on Arrow batches.

Quotes of either kind open a string, a backslash in a string takes the next character, and brackets in strings don't
count. Plain functions on one text, and the pandas functions that apply them to columns.
"""

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F

_PIECES = {
    pair: re.compile(r'"(?:[^"\\]|\\.)*"' + r"|'(?:[^'\\]|\\.)*'" + rf"|[\"'{re.escape(pair)}]", re.S)
    for pair in ("{}", "()")
}
CALL = re.compile(r"TOOL_CALL:\s*(\w+)[ \t]*(?=\()")
DISPATCH = re.compile(r"(\w+)\s*\((.+)\)\s*\Z", re.S)
ARGUMENT = "execute_code("
PASS = re.compile(r"^OBSERVATION:\s*PASS\b", re.M)
FINAL = re.compile(r"^FINAL_ANSWER:", re.M)
EXECUTE = re.compile(r"TOOL_CALL:\s*execute_code\(")


def bracket_end(text: str, at: int, pair: str = "{}") -> int:
    """Where the first bracket pair that opens at or after at has closed (exclusive), or -1."""
    depth = 0
    for m in _PIECES[pair].finditer(text, at):
        piece = m.group()
        if len(piece) > 1:
            continue
        if piece in "\"'":
            return -1  # a string that never ends
        depth += 1 if piece == pair[0] else -1
        if depth == 0 and piece == pair[1]:
            return m.end()
    return -1


def parsed(raw: str):
    """(value, None), or (None, the error) if raw isn't exactly one JSON value."""
    try:
        return json.loads(raw), None
    except (json.JSONDecodeError, RecursionError) as e:
        return None, e


def code_of(value) -> str:
    code = value.get("code", "") if isinstance(value, dict) else ""
    return code if isinstance(code, str) else ""


def argument_places(text: str):
    """(place of the call, end of its argument, argument's value or None, whether it is JSON) of each execute_code(."""
    at = text.find(ARGUMENT)
    while at >= 0:
        begin = at + len(ARGUMENT)
        end = bracket_end(text, begin)
        if end >= 0:
            value, error = parsed(text[begin:end])
            yield at, end, value, error is None
        at = text.find(ARGUMENT, at + 1)


def code_bodies(text: str) -> list:
    """The code of each execute_code call; None for one whose argument is broken JSON; calls without code give nothing."""
    found = [(None if not fine else code_of(value), fine) for _, _, value, fine in argument_places(text)]
    return [code for code, fine in found if not fine or code]


def parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return False
    return True


def pending_call(text: str, after: int) -> tuple[int, str, int]:
    """(place of the next call marker past after, the call, its end); an empty call and -1 if it isn't all there yet."""
    at = text.find("TOOL_CALL:", after + 1)
    if at < 0:
        return -1, "", -1
    m = CALL.match(text, at)
    end = bracket_end(text, m.end(), "()") if m else -1
    return (at, text[m.start(1) : end], end) if end >= 0 else (at, "", -1)


def dispatch_class(call: str, tools: frozenset) -> str:
    """unparsable, unknown, invalid_json, fixed_quotes (JSON once single quotes are double), or ok."""
    m = DISPATCH.match(call.strip())
    if not m:
        return "unparsable"
    if m.group(1) not in tools:
        return "unknown"
    raw = m.group(2).strip()
    if parsed(raw)[1] is None:
        return "ok"
    return "fixed_quotes" if parsed(raw.replace("'", '"'))[1] is None else "invalid_json"


def passing_call(text: str) -> str | None:
    """The last execute_code call before the first passing observation, with its argument as one JSON object."""
    stop = text.find("OBSERVATION: PASS")
    marker = "TOOL_CALL: " + ARGUMENT
    at = text.rfind(marker, 0, stop) if stop >= 0 else -1
    begin = at + len(marker)
    if at < 0 or text[begin : begin + 1] != "{":
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, begin)
    except (json.JSONDecodeError, RecursionError):
        return None
    return f"{marker}{text[begin:end]})" if ")" in text[end:] else None


def argument_state(call: str | None) -> str:
    """What is wrong with the argument of a stored call: "", unmatched, invalid, no_code, or syntax."""
    call = (call or "").strip()
    marker = "TOOL_CALL: " + ARGUMENT
    if not call.startswith(marker):
        return ""
    body = call[len(marker) :]
    if not body.endswith(")"):
        return "unmatched"
    value, error = parsed(body[:-1])
    if error is not None:
        return "invalid"
    if not isinstance(value, dict) or "code" not in value:
        return "no_code"
    return "" if not code_of(value) or parses(code_of(value)) else "syntax"


def quality(text: str) -> tuple[int, int, int]:
    """(calls with JSON, calls without, 1 if the last code doesn't parse) of a response without observations."""
    bodies = code_bodies(text)
    fine = [b for b in bodies if b is not None]
    return len(fine), len(bodies) - len(fine), int(bool(fine) and not parses(fine[-1]))


def successful_codes(text: str) -> list[str]:
    """The code of each call that a passing observation follows, no other observation being between them."""
    out = []
    for m in PASS.finditer(text):
        calls = list(EXECUTE.finditer(text, 0, m.start()))
        if not calls or "OBSERVATION:" in text[calls[-1].start() : m.start()]:
            continue
        end = bracket_end(text, calls[-1].end())
        code = code_of(parsed(text[calls[-1].end() : end])[0]) if end >= 0 else ""
        if code:
            out.append(code)
    return out


def says_pass(code: str) -> bool:
    return "print('PASS')" in code or 'print("PASS")' in code


def pass_discipline(text: str) -> tuple[int, int, int]:
    """(passing calls that don't print PASS, that assert nothing, 1 if the answer comes before the first pass)."""
    codes = successful_codes(text)
    first, answer = PASS.search(text), FINAL.search(text)
    early = bool(answer) and bool(EXECUTE.search(text)) and (first is None or answer.start() < first.start())
    return sum(not says_pass(c) for c in codes), sum("assert " not in c for c in codes), int(early)


def audit_codes(text: str) -> list[str]:
    """The issues of a response that need a scanner: JSON, escapes and syntax of its calls, and pass discipline."""
    issues, codes = [], []
    for at, end, value, fine in argument_places(text):
        if not fine and "OBSERVATION: ERROR: invalid JSON" not in text[end : end + 200]:
            issues.append("invalid_json_in_execute_code")
        elif fine and code_of(value):
            codes.append((at, code_of(value)))
    if any("\\n" in code for _, code in codes):
        issues.append("double_escaped_newline_in_execute_code")
    if codes and "OBSERVATION: ERROR" not in text[codes[-1][0] :].partition("OBSERVATION: PASS")[0] and not parses(codes[-1][1]):
        issues.append("unparseable_python_in_last_execute_code")
    for code in successful_codes(text):
        issues += ["successful_execute_code_no_print_pass"] * (not says_pass(code))
        issues += ["successful_execute_code_no_assert"] * ("assert " not in code)
    return issues


#: Prefixes that the last resort of code extraction skips, and those that begin a statement.
SKIP = ("TOOL_CALL:", "OBSERVATION:", "FIXED:", "CRITIQUE:", "FINAL_ANSWER:", "[SYSTEM", "[DEBUG", "RUNTIME-INJECTED")
BEGIN = ("def ", "class ", "import ", "from ", "assert ", "print(")


def statement_lines(text: str) -> str:
    """Lines that look like Python: from one that begins a statement, as long as they are indented, blank or comments."""
    keep, inside = [], False
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith(SKIP):
            inside = False
        elif bare.startswith(BEGIN):
            inside = True
            keep.append(line)
        elif inside:
            inside = line[:1] in (" ", "\t") or not bare or bare.startswith("#")
            if inside:
                keep.append(line)
    return "\n".join(keep).strip()


def _column(f, kind: str):
    @F.pandas_udf(kind)
    def column(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(f)

    return column


def call_code(call: str) -> str | None:
    """The code of one call of execute_code; None if there is none to read."""
    for _, _, value, fine in argument_places(call):
        return code_of(value) if fine and isinstance(value, dict) else None
    return None


def _each(f, kind: str):
    @F.pandas_udf(f"array<{kind}>")
    def column(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: [f(x or "") for x in xs] if xs is not None else [])

    return column


def _struct(f, names: list[str], kind: str):
    @F.pandas_udf(", ".join(f"{n} {k}" for n, k in zip(names, kind.split())))
    def column(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(t) for t in texts.fillna("")], columns=names)

    return column


def columns() -> dict:
    """The pandas functions, made on first use, as they need a session."""
    if not _made:
        _made.update(
            code_bodies=_column(code_bodies, "array<string>"),
            parses=_column(parses, "boolean"),
            passing_call=_column(passing_call, "string"),
            argument_state=_column(argument_state, "string"),
            audit_codes=_column(audit_codes, "array<string>"),
            statement_lines=_column(statement_lines, "string"),
            code_bodies_of_calls=_each(call_code, "string"),
            quality=_struct(quality, ["n_calls", "bad_json", "bad_code"], "bigint bigint bigint"),
            pass_discipline=_struct(pass_discipline, ["no_print_pass", "no_assert", "early_answer"], "bigint bigint bigint"),
            pending_call=_struct(lambda t: pending_call(t, -1), ["place", "call", "end"], "bigint string bigint"),
        )
    return _made


_made: dict = {}


def dispatch_column(tools: frozenset):
    return _column(lambda call: dispatch_class(call, tools), "string")
