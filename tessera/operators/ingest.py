"""Queries on sources: gates of JSON lines, task lists, CSV text, built-in relations, templates, checks of task lists."""

import operator
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol as P
from ..plans import transcripts as T
from ..plans.registry import query
from ..plans.storage import working_dir
from ..sources import files

_SCHEMA = "id string, task string, prompt string, n bigint"
_NEEDED = ["id", "prompt"]
_J = f"j AS (SELECT file, number, trim(line) AS line FROM {T.JSON_LINES} AS x WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')), p AS (SELECT *, CASE WHEN NOT json_valid(line) THEN 'json_error' WHEN coalesce(json_extract_string(line, '$.id'), '') = '' OR coalesce(json_extract_string(line, '$.prompt'), '') = '' THEN 'FAIL' ELSE 'OK' END AS status FROM j)"


def _rows(t) -> DataFrame:
    return files.parse_lines(T.rows_of(t, T.JSON_LINES), _SCHEMA)


_GATE = f"WITH {_J} SELECT count_if(status <> 'OK')::BIGINT AS failed, count_if(status = 'OK')::BIGINT AS valid, CASE WHEN count_if(status <> 'OK') > 0 THEN 'ABORT: ' || count_if(status <> 'OK') || ' record(s) failed validation' WHEN count_if(status = 'OK') = 0 THEN 'ABORT: no valid records' ELSE 'OK' END AS verdict FROM p"


@query("jsonl_gate", _GATE)
def jsonl_gate(t):
    return files.gate_verdict(_rows(t), _NEEDED)


@query("jsonl_gate_files", _GATE)
def jsonl_gate_files(t):
    """The same of files: the lines are written as text, a folder for each file's name, and scanned."""
    path = f"{working_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    T.rows_of(t, T.JSON_LINES).select("file", "line").write.partitionBy("file").text(path)
    return files.gate_verdict(files.json_lines(t.spark, path, _SCHEMA), _NEEDED)


@query("jsonl_dryrun_report", f"WITH {_J} SELECT file, number, status, json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.id') AS id, sum(CASE WHEN status <> 'json_error' THEN 1 ELSE 0 END) OVER (PARTITION BY file)::BIGINT AS total, sum(CASE WHEN status <> 'OK' THEN 1 ELSE 0 END) OVER (PARTITION BY file)::BIGINT AS failed FROM p")
def jsonl_dryrun_report(t):
    """Each line's status, with its file's counts: a line that isn't JSON is failed, but not in the total."""
    report = files.gate_report(_rows(t), _NEEDED).select("file", "total", "failed")  # a row a file
    return files.judged(_rows(t), _NEEDED).join(report, "file").select("file", "number", "status", "id", "total", "failed")


@query("jsonl_lenient", f"WITH {_J} SELECT number, json_extract_string(line, '$.id') AS id, json_extract(line, '$.n')::BIGINT AS n FROM p WHERE status <> 'json_error'")
def jsonl_lenient(t):
    return files.lenient(_rows(t)).select("number", "id", "n")


@query("task_load_strict", f"WITH {_J} SELECT number, json_extract_string(line, '$.id') AS id, 'external' AS category, json_extract_string(line, '$.prompt') AS task FROM p WHERE status = 'OK'")
def task_load_strict(t):
    """Tasks with defaults, from the lines that are fit; any other line would raise an error."""
    good = T.rows_of(t, T.JSON_LINES).where("number % 10 >= 6 or number % 10 = 1 or number % 10 = 0 or number % 10 = 4")
    tasks = files.strict(files.parse_lines(good, _SCHEMA + ", category string"), ["id", "prompt|task"])
    return tasks.select("number", "id", F.coalesce("category", F.lit("external")).alias("category"), F.coalesce(F.nullif(F.col("prompt"), F.lit("")), F.col("task")).alias("task"))


@query("csv_scan", "SELECT doc_id::VARCHAR AS id, replace(left(text, 40), chr(10), ' ') AS text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS lang FROM documents")
def csv_scan(t):
    """Lines of CSV, quotes doubled; all values are text, and empty ones the empty text."""
    quote = F.lit('"')
    text = F.replace(F.replace(F.left("text", F.lit(40)), F.lit("\n"), F.lit(" ")), quote, F.lit('""'))
    line = F.concat(F.col("doc_id").cast("string"), F.lit(","), quote, text, quote, F.lit(","), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")))
    parsed = t.documents.select(F.from_csv(line, "id string, text string, lang string", {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("x"))
    return parsed.select(*[F.coalesce(f"x.{c}", F.lit("")).alias(c) for c in ("id", "text", "lang")])


#: The built-in tasks, with what an observation must hold, one alternative of several parts, to pass.
TASKS = [
    ("fizzbuzz", "basic", False, [["FizzBuzz"]]),
    ("factorial", "basic", False, [["3628800"]]),
    ("palindrome", "basic", False, [["True", "False"]]),
    ("sum_list", "basic", False, [["15"]]),
    ("binary_search", "medium", False, [["3"]]),
    ("flatten", "medium", True, [["1, 2, 3, 4, 5, 6"]]),
    ("word_count", "medium", True, [["2", "the"], ["2", "cat"]]),
    ("merge_sorted", "medium", False, [["1, 2, 3, 4, 5, 6"]]),
    ("lru_cache", "hard", True, [["-1"]]),
    ("graph_bfs", "hard", True, [["A", "B", "D"]]),
    ("roman_numerals", "hard", True, [["MCMXCIV"], ["LVIII"]]),
    ("bugfix_off_by_one", "bugfix", True, [["55"]]),
    ("bugfix_index_error", "bugfix", True, [["last"]]),
    ("safe_divide", "edge-case", True, [["5"]]),
    ("clamp", "edge-case", True, [["0", "10"]]),
    ("unique_sorted", "edge-case", True, [["1, 2, 3"]]),
]


def _rule(name: str, ways: list[list[str]]):
    """The check of one observation."""

    def fine(o: Column) -> Column:
        x = F.lower(o) if name in ("word_count", "bugfix_index_error") else o
        hit = reduce(operator.or_, [reduce(operator.and_, [F.contains(x, F.lit(part)) for part in parts]) for parts in ways])
        if name == "fizzbuzz":
            return hit & (F.size(F.split(P.strip(o), r"\s+")) >= 3)
        return hit & ~F.contains(x, F.lit("error")) if name == "bugfix_index_error" else hit

    return fine


def task_check(task: Column, observations: Column) -> Column:
    """Whether an observation passes the task's own check; a task without one passes by P.passes."""
    out = None
    for name, _, _, ways in TASKS:
        rule = F.exists(observations, _rule(name, ways))
        out = F.when(task == name, rule) if out is None else out.when(task == name, rule)
    return out.otherwise(P.passes(observations))


@query("values_source", "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{c}', {str(h).lower()})" for i, c, h, _ in TASKS) + ") AS v(id, category, critique_helpful)")
def values_source(t):
    return t.spark.createDataFrame([x[:3] for x in TASKS], "id string, category string, critique_helpful boolean")


_OBS = "CASE doc_id % 5 WHEN 0 THEN '1 2 FizzBuzz' WHEN 1 THEN '15' WHEN 2 THEN 'PASS' WHEN 3 THEN 'PASS Error' ELSE 'FizzBuzz' END"


@query("task_check", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN contains(o, 'FizzBuzz') AND len(string_split(o, ' ')) >= 3 WHEN 1 THEN contains(o, '15') ELSE contains(o, 'PASS') AND NOT contains(o, 'Error') END AS ok FROM (SELECT doc_id, {_OBS} AS o FROM documents)")
def task_check_query(t):
    task = F.when(F.col("doc_id") % 3 == 0, "fizzbuzz").when(F.col("doc_id") % 3 == 1, "sum_list").otherwise("other")
    return t.documents.select("doc_id", task_check(task, F.array(F.expr(_OBS))).alias("ok"))


#: Templates of synthetic examples.
TOPICS = ["machine learning", "neural networks", "Python programming", "data structures", "algorithms", "linear algebra", "statistics", "natural language processing", "computer vision", "reinforcement learning", "optimization", "transformers", "attention mechanisms", "gradient descent", "backpropagation", "regularization"]
TEMPLATES = ["Explain {topic} in simple terms.", "What is {topic}?", "Summarize the following: {topic}."]


@query("template_cross", "SELECT replace(t, '{topic}', p) AS instruction FROM (VALUES " + ", ".join(f"('{x}')" for x in TEMPLATES) + ") AS a(t), (VALUES " + ", ".join(f"('{x}')" for x in TOPICS) + ") AS b(p)")
def template_cross(t):
    """Every template with every topic: both are literal lists, so no join is needed."""
    one = t.spark.range(1).select(F.explode(F.array(*map(F.lit, TEMPLATES))).alias("t"), F.array(*map(F.lit, TOPICS)).alias("ps"))
    return one.select("t", F.explode("ps").alias("p")).select(F.replace("t", F.lit("{topic}"), F.col("p")).alias("instruction"))


@query("image_semijoin", "SELECT doc_id, path FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'p' || doc_id END AS path FROM documents) WHERE path <> '' AND path IN (SELECT 'p' || page_id FROM pages)")
def image_semijoin(t):
    """Rows whose path isn't empty and exists."""
    path = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    there = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"))
    return t.documents.select("doc_id", path.alias("path")).where("path <> ''").join(there, "path", "left_semi").select("doc_id", "path")


@query("family_lookup", "SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'unknown') AS family, coalesce('task ' || l.doc_id, d.doc_id::VARCHAR) AS task FROM documents d LEFT JOIN labels l USING (doc_id)")
def family_lookup(t):
    meta = t.labels.select("doc_id", F.col("quality").cast("string").alias("family"), F.concat(F.lit("task "), F.col("doc_id").cast("string")).alias("task"))
    return t.documents.select("doc_id").join(meta, "doc_id", "left").select("doc_id", F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("task", F.col("doc_id").cast("string")).alias("task"))


@query("keyword_hit", "SELECT doc_id, contains(lower(text), 'tion') OR contains(lower(text), ' über ') AS hit FROM documents")
def keyword_hit(t):
    low = F.lower("text")
    return t.documents.select("doc_id", F.exists(F.array(F.lit("TION"), F.lit(" über ")), lambda k: F.contains(low, F.lower(k))).alias("hit"))


@query("package_guard", "SELECT doc_id, CASE WHEN p = '' THEN 'ERROR: provide package' WHEN regexp_matches(p, '[;&|>< \n]') THEN 'ERROR: invalid package name' WHEN split_part(lower(p), '[', 1) IN ('rm', 'wget', 'curl', 'bash', 'sh', 'os', 'sys') THEN 'ERROR: blocked name' ELSE '' END AS error FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a;b' WHEN 2 THEN 'Bash[x]' WHEN 3 THEN 'numpy' ELSE source END AS p FROM documents)")
def package_guard(t):
    n = F.col("doc_id") % 5
    p = P.strip(F.when(n == 0, "").when(n == 1, "a;b").when(n == 2, "Bash[x]").when(n == 3, "numpy").otherwise(F.col("source")))
    blocked = F.substring_index(F.lower(p), "[", 1).isin("rm", "wget", "curl", "bash", "sh", "os", "sys")
    return t.documents.select("doc_id", F.when(p == "", "ERROR: provide package").when(F.regexp_like(p, F.lit("[;&|>< \n]")), "ERROR: invalid package name").when(blocked, "ERROR: blocked name").otherwise("").alias("error"))


# --- checks of task lists: (check, n_bad, ok) ---


def checks(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """One row a check, in one pass: how many rows break it."""
    counted = df.agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n_bad")) for k in bad])).alias("x")
    return counted.select(rows).select("x.check", "x.n_bad", (F.col("x.n_bad") == 0).alias("ok"))


def _checks_sql(source: str, bad: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count_if({c})::BIGINT AS n_bad, count_if({c}) = 0 AS ok FROM {source}" for k, c in bad.items())


_AFTER = "array_to_string(list_filter(list_transform(string_split(transcript, chr(10)), lambda x, i: CASE WHEN i > list_position(list_transform(string_split(transcript, chr(10)), lambda y: contains(y, 'OBSERVATION:')), true) THEN x END), lambda x: x IS NOT NULL), chr(10))"


@query("dq_recovery", f"WITH t AS (SELECT * FROM {T.TRANSCRIPTS} AS x) " + _checks_sql("t", {
    "no_failed_observation": "NOT regexp_matches(transcript, 'OBSERVATION:\\s*(ERROR|PASS|\\(no output\\))')", "no_call": "NOT contains(transcript, 'TOOL_CALL:')",
    "leaks_pass": "contains(transcript, 'OBSERVATION: PASS')", "prints_pass_after_observation": f"contains(coalesce({_AFTER}, ''), {T.lit('print(' + chr(39) + 'PASS' + chr(39) + ')')})"}))
def dq_recovery(t):
    x = F.col("transcript")
    first = F.array_position(F.transform(P.lines(x), lambda y: F.contains(y, F.lit("OBSERVATION:"))), True)
    after = F.when(first > 0, F.array_join(F.slice(P.lines(x), (first + 1).cast("int"), F.size(P.lines(x))), "\n")).otherwise("")
    return checks(T.transcripts(t), {
        "no_failed_observation": ~F.regexp_like(x, F.lit(r"OBSERVATION:\s*(ERROR|PASS|\(no output\))")), "no_call": ~F.contains(x, F.lit("TOOL_CALL:")),
        "leaks_pass": F.contains(x, F.lit("OBSERVATION: PASS")), "prints_pass_after_observation": F.contains(after, F.lit("print('PASS')")),
    })


_LIBRARIES = ["numpy", "pandas", "requests"]
_CODE = f"CASE doc_id % 4 WHEN 0 THEN 'assert a' || chr(10) || 'assert b' || chr(10) || 'assert c' || chr(10) || {T.lit('print(' + chr(39) + 'PASS' + chr(39) + ')')} WHEN 1 THEN 'import numpy' || chr(10) || 'assert a' WHEN 2 THEN 'from requests import get' ELSE '' END"


@query("dq_verification", f"WITH v AS (SELECT doc_id, {_CODE} AS code FROM documents) " + _checks_sql("v", {
    "no_pass_print": f"NOT contains(code, {T.lit('print(' + chr(39) + 'PASS' + chr(39) + ')')})", "few_asserts": "(length(code) - length(replace(code, 'assert ', ''))) // 7 < 3",
    "external_library": " OR ".join(f"contains(code, 'import {x}') OR contains(code, 'from {x}')" for x in _LIBRARIES)}))
def dq_verification(t):
    code = F.expr(_CODE)
    external = P.has_any(code, [f"{w} {x}" for x in _LIBRARIES for w in ("import", "from")])
    asserts = F.floor((F.length(code) - F.length(F.replace(code, F.lit("assert "), F.lit("")))) / 7)
    return checks(t.documents.select("doc_id"), {"no_pass_print": ~F.contains(code, F.lit("print('PASS')")), "few_asserts": asserts < 3, "external_library": external})


#: What a category's texts must mention, one word at least.
KEYWORDS = {"en": ["the", "of"], "de": ["und", "der"], "fr": ["le", "de"], "es": ["que", "el"]}


@query("dq_keywords", _checks_sql("documents", {k: f"lang = '{k}' AND NOT (" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + ")" for k, ws in KEYWORDS.items()}))
def dq_keywords(t):
    return checks(t.documents, {k: (F.col("lang") == k) & ~P.has_any(F.lower("text"), ws) for k, ws in KEYWORDS.items()})
