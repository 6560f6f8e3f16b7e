"""Corpus curation: scans and gates, deduplication, leak and contamination joins, blending, masking, text rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.registry import query
from .containment import contained
from .memory import keep_first
from .sequence import global_index

def pool_order(pool: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """pool with _r, each row's place from 1 in the order of a seeded hash."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    ranked = global_index(pool.withColumn("_h", order), ["_h", key], "_r")
    return ranked.withColumn("_r", F.col("_r") + 1).drop("_h")


def blends(base: DataFrame, ordered: DataFrame, shares: list[float]) -> DataFrame:
    """For each share, base and as many rows of the ordered pool, from its first on, as make up share of the whole (all at
    1); share says which. The pool is read once, whatever the number of shares."""
    need = lambda s: F.lit(0) if s <= 0 else F.lit((1 << 63) - 1) if s >= 1 else F.ceil(F.lit(s) * F.count("*") / F.lit(1 - s))
    wanted = F.array(*[F.struct(F.lit(s).alias("share"), need(s).cast("bigint").alias("n")) for s in shares])
    limits = F.broadcast(base.agg(wanted.alias("_limits")))  # one row
    picked = ordered.crossJoin(limits).withColumn("_x", F.explode(F.filter("_limits", lambda x: F.col("_r") <= x["n"])))
    whole = base.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return whole.unionByName(picked.withColumn("share", F.col("_x.share")).drop("_r", "_limits", "_x"))


def blend(base: DataFrame, ordered: DataFrame, share: float) -> DataFrame:
    """base and as many rows of the ordered pool as make up share of the whole."""
    return blends(base, ordered, [share]).drop("share")


def mask_labels(prompt: Column, target: Column, limit: int) -> Column:
    """The ids of prompt and target in at most limit, prompt cut at its left, labels -100 for the prompt; null if the
    target alone doesn't fit."""
    keep = F.least(F.size(prompt), F.lit(limit) - F.size(target))
    cut = F.slice(prompt, F.size(prompt) - keep + 1, keep)
    made = F.struct(F.concat(cut, target).alias("input_ids"), F.concat(F.array_repeat(F.lit(-100), keep), target).alias("labels"))
    return F.when(F.size(target) < limit, made)


@query("dedup_keep_first", "SELECT doc_id, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1")
def dedup_keep_first(t):
    return keep_first(t.documents.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h")), ["h"], ["source", "doc_id"]).select("doc_id", "h")


@query("contains_join", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_join(t):
    """Benchmark items that lie in a document."""
    return contained(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query("overlap_semi", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 1)")
def overlap_semi(t):
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return d.where("doc_id % 2 = 0").join(d.where("doc_id % 2 = 1").select("h"), "h", "left_semi").select("doc_id")


@query("overlap_anti", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 1)")
def overlap_anti(t):
    d = t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return d.where("doc_id % 2 = 0").join(d.where("doc_id % 2 = 1").select("h"), "h", "left_anti").select("doc_id")


@query("prefix_overlap", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON left(b.text, 40) = left(d.text, 40)")
def prefix_overlap(t):
    return t.benchmark.select("item_id", F.left("text", F.lit(40)).alias("p")).join(t.documents.select("doc_id", F.left("text", F.lit(40)).alias("p")), "p").select("item_id", "doc_id")


@query("union_ids", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_ids(t):
    return t.documents.select("doc_id").union(t.labels.select("doc_id")).distinct()


@query("intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_ids(t):
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("union_pools", "SELECT 'doc' AS pool, doc_id AS id FROM documents UNION ALL SELECT 'bench', item_id FROM benchmark")
def union_pools(t):
    return t.documents.select(F.lit("doc").alias("pool"), F.col("doc_id").alias("id")).unionByName(t.benchmark.select(F.lit("bench").alias("pool"), F.col("item_id").alias("id")))


_SHARES = (0.0, 0.1, 0.25, 0.5, 1.0)


@query("blend_ratio", "WITH b AS (SELECT doc_id FROM documents WHERE lang = 'en'), p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents WHERE lang <> 'en'), n AS (SELECT count(*) AS n FROM b) " + " UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, doc_id FROM b UNION ALL SELECT {s}::DOUBLE, doc_id FROM p, n WHERE " + ("false" if s == 0 else "true" if s == 1 else f"r <= ceil({s}::DOUBLE * n / (1 - {s}::DOUBLE))") for s in _SHARES))
def blend_ratio(t):
    base, pool = t.documents.where("lang = 'en'").select("doc_id"), t.documents.where("lang <> 'en'").select("doc_id")
    return blends(base, pool_order(pool, "doc_id"), list(_SHARES)).select("share", "doc_id")


@query("blend_share", "SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def blend_share(t):
    n = F.broadcast(t.documents.agg(F.count("*").alias("all")))
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(n).select("lang", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("weighted_pool", "SELECT doc_id, unnest(range(1, doc_id % 3 + 2)) AS copy FROM documents")
def weighted_pool(t):
    return t.documents.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("doc_id") % 3 + 1)).alias("copy"))


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def hash_sample(t):
    return t.documents.select("doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(100).select("doc_id")


@query("priority_limit", "SELECT doc_id FROM documents ORDER BY (lang <> 'de')::INT, source, doc_id LIMIT 50")
def priority_limit(t):
    return t.documents.orderBy((F.col("lang") != "de").cast("int"), "source", "doc_id").limit(50).select("doc_id")


def gates(pool: DataFrame, kind: str, least: float, most: float, count: int) -> DataFrame:
    """(kind, share_ok, count_ok): whether a kind's share of the pool lies in bounds, and whether it has rows enough."""
    n = F.broadcast(pool.agg(F.count("*").alias("all")))  # one row
    share = F.col("n") / F.col("all")
    return pool.groupBy(kind).agg(F.count("*").alias("n")).crossJoin(n).select(kind, share.between(least, most).alias("share_ok"), (F.col("n") >= count).alias("count_ok"))


def gated_pool(pool: DataFrame, kind: str, least: float, most: float, count: int) -> DataFrame:
    """pool, if every kind passes its gates and there is one; else ValueError, with up to ten kinds that don't."""
    judged = gates(pool, kind, least, most, count)
    bad = judged.where("not (share_ok and count_ok)").orderBy(kind).limit(10).collect()
    if bad or judged.isEmpty():
        raise ValueError("; ".join(f"{r[kind]}: {' and '.join(w for w, ok in (('share', r.share_ok), ('count', r.count_ok)) if not ok)} out of bounds" for r in bad) or "the pool is empty")
    return pool


@query("pool_gates", "SELECT lang, count(*) / (SELECT count(*) FROM documents) BETWEEN 0.05 AND 0.6 AS share_ok, count(*) >= 100 AS count_ok FROM documents GROUP BY 1")
def pool_gates(t):
    return gates(t.documents, "lang", 0.05, 0.6, 100)


@query("query_text", "SELECT doc_id, 'doc_' || doc_id || ' ' || lang || ' ' || array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:20], ' ') AS query_text FROM documents")
def query_text(t):
    return t.documents.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit(" "), X.first_words(F.col("text"), 20)).alias("query_text"))


@query("truncate_flag", "SELECT doc_id, md5(left(text, 3000)) AS head, length(text) > 3000 AS truncated FROM documents")
def truncate_flag(t):
    return t.documents.select("doc_id", F.md5(F.left("text", F.lit(3000)).cast("binary")).alias("head"), (F.length("text") > 3000).alias("truncated"))


@query("truncate_cols", "SELECT doc_id, length(left(text, 200)) AS n200, length(left(text, 1000)) AS n1000, length(left(text, 6000)) AS n6000 FROM documents")
def truncate_cols(t):
    return t.documents.select("doc_id", *[F.length(F.left("text", F.lit(n))).cast("bigint").alias(f"n{n}") for n in (200, 1000, 6000)])


@query("coalesce_prompt", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS prompt FROM documents")
def coalesce_prompt(t):
    return t.documents.select("doc_id", X.first_truthy(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")), F.col("source")).alias("prompt"))


@query("text_samples", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN lang || ' ' || text ELSE text END) AS h FROM documents WHERE length(text) > 0")
def text_samples(t):
    return t.documents.where("length(text) > 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "lang", "text")).otherwise(F.col("text")).cast("binary")).alias("h"))


def long_enough(text: Column, tokens: Column, target: Column, seq_len: int, most: int, least: int = 8) -> Column:
    """Why a text isn't used, the first that holds, or empty: too short for a window, too few tokens, too long a target."""
    return F.when(F.length(text) <= seq_len + 1, "short text").when(F.size(tokens) < least, "few tokens").when(F.size(target) >= most, "long target").otherwise("")


@query("length_gate", r"SELECT doc_id, CASE WHEN length(text) <= 65 THEN 'short text' WHEN len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) < 8 THEN 'few tokens' WHEN len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) >= 500 THEN 'long target' ELSE '' END AS reason FROM documents")
def length_gate(t):
    tokens = X.words(F.col("text"))
    return t.documents.select("doc_id", long_enough(F.col("text"), tokens, tokens, 64, 500).alias("reason"))


def chosen_tasks(tasks: DataFrame, column: str, wanted: list) -> DataFrame:
    """The tasks whose column is wanted; an error if there is none."""
    found = tasks.where(F.col(column).isin(*wanted))
    if found.isEmpty():
        raise ValueError(f"no tasks match {column} in {wanted}")
    return found


@query("task_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def task_filter(t):
    return chosen_tasks(t.documents, "lang", ["de", "fr"]).select("doc_id", "lang")


@query("target_tasks", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def target_tasks(t):
    return t.documents.select("doc_id").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


#: What a command may begin with, and what it must not hold.
ALLOWED_COMMANDS = ["python", "python3", "pytest", "py.test", "grep", "find", "ls", "cat", "git diff", "git log", "git status", "git show", "sed", "head", "tail", "wc"]
BLOCKED_COMMANDS = [r"\brm\b", r"\brmdir\b", r"\bsudo\b", r"\bchmod\b", r"\bcurl\b", r"\bwget\b", r"\bdd\b", r">\s*/", r">\s*~", r"\.\./\.\./\.\./"]


def command_policy(command: Column) -> Column:
    """blocked (a pattern matches), not allowed (no prefix does), or ok."""
    c = F.trim(command, F.lit(X.WHITE))
    starts = F.exists(F.array(*map(F.lit, ALLOWED_COMMANDS)), lambda p: (c == p) | F.startswith(c, F.concat(p, F.lit(" "))))
    blocked = F.regexp_like(command, F.lit("|".join(BLOCKED_COMMANDS)))
    return F.when(blocked, "blocked").when(starts, "ok").otherwise("not allowed")


_COMMANDS = ["ls -l", "grep x", "rm -rf x", "python a.py", "pythonx", "cat a > /etc/x", " git diff ", "sudo ls", "wc", "", "echo ~", "cat ../../../x", "head a >~b", "git push", "harmless farm"]
_COMMAND = f"CASE doc_id % {len(_COMMANDS)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COMMANDS)) + " END"


@query("command_policy", f"SELECT doc_id, CASE WHEN {' OR '.join(f'regexp_matches(c, {chr(39)}{b}{chr(39)})' for b in BLOCKED_COMMANDS)} THEN 'blocked' WHEN {' OR '.join(f'trim(c) = {chr(39)}{p}{chr(39)} OR starts_with(trim(c), {chr(39)}{p} {chr(39)})' for p in ALLOWED_COMMANDS)} THEN 'ok' ELSE 'not allowed' END AS policy FROM (SELECT doc_id, {_COMMAND} AS c FROM documents)")
def command_policy_query(t):
    return t.documents.select("doc_id", command_policy(F.expr(_COMMAND)).alias("policy"))


@query("grep_lines", "SELECT doc_id, pos - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(line, '[0-9]{3}')")
def grep_lines(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike("[0-9]{3}")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("stop_truncate", "SELECT page_id, split_part(split_part(html, '</head>', 1), '<style>', 1) AS head FROM pages")
def stop_truncate(t):
    return t.pages.select("page_id", F.substring_index(F.substring_index("html", "</head>", 1), "<style>", 1).alias("head"))


#: What a test runner's exit codes mean.
EXITS = {0: "ALL PASSED", 1: "SOME FAILED", 2: "INTERRUPTED", 3: "INTERNAL ERROR", 4: "USAGE ERROR", 5: "NO TESTS COLLECTED"}


def tool_result(output: Column, code: Column, most: int = 45) -> Column:
    """A test run's header, from its exit code and its last line that sums up, and the last lines of its output."""
    rows = F.split(output, "\n")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXITS.items() for x in kv]), code.cast("int")), F.concat(F.lit("EXIT "), code.cast("string")))
    sums = F.filter(rows, lambda x: F.contains(x, F.lit("passed")) | F.contains(x, F.lit("failed")) | F.contains(F.lower(x), F.lit("error")))
    header = F.trim(F.concat(F.lit("["), label, F.lit("] "), F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(""))))
    body = F.when(F.size(rows) > most, F.array_join(F.slice(rows, F.size(rows) - most + 1, most), "\n")).otherwise(output)
    return F.when(output == "", header).otherwise(F.concat(header, F.lit("\n"), body))


@query("tail_lines", f"WITH o AS (SELECT doc_id, trim(text, ' ' || chr(10)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '3 passed in 0.1s' ELSE '' END AS t FROM documents), l AS (SELECT doc_id, t, string_split(t, chr(10)) AS x FROM o) SELECT doc_id, md5(trim('[' || CASE doc_id % 7 {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in EXITS.items())} ELSE 'EXIT 6' END || '] ' || coalesce(list_filter(x, lambda y: contains(y, 'passed') OR contains(y, 'failed') OR contains(lower(y), 'error'))[-1], '')) || CASE WHEN t = '' THEN '' WHEN len(x) > 45 THEN chr(10) || array_to_string(x[-45:], chr(10)) ELSE chr(10) || t END) AS tail FROM l")
def tail_lines(t):
    output = F.concat(F.trim("text", F.lit(" \n")), F.when(F.col("doc_id") % 2 == 0, "\n3 passed in 0.1s").otherwise(""))
    return t.documents.select("doc_id", F.md5(tool_result(output, F.col("doc_id") % 7).cast("binary")).alias("tail"))


@query("replace_first", "SELECT doc_id, md5(CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) ELSE text END) AS h FROM documents")
def replace_first(t):
    return t.documents.select("doc_id", F.md5(X.replace_first(F.col("text"), F.lit("the"), F.lit("THE")).cast("binary")).alias("h"))


@query("chat_flatten", "SELECT conv_id, md5(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'ASSISTANT:') AS chat FROM conversations GROUP BY 1")
def chat_flatten(t):
    line = F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.col("text")).alias("s"))
    flat = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n")
    return t.conversations.groupBy("conv_id").agg(F.md5(F.concat(flat, F.lit("\nASSISTANT:")).cast("binary")).alias("chat"))


@query("join_obs", "SELECT conv_id, md5(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn)) AS obs FROM conversations GROUP BY 1")
def join_obs(t):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.conversations.groupBy("conv_id").agg(F.md5(F.array_join(listed, "\n---\n").cast("binary")).alias("obs"))


@query("dup_calls", "SELECT user_id, count(*) - count(DISTINCT event_type) AS dup FROM events GROUP BY 1")
def dup_calls(t):
    return t.events.groupBy("user_id").agg((F.count("*") - F.count_distinct("event_type")).alias("dup"))


@query("safe_int", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE event_type END AS INT), 0) AS n FROM events")
def safe_int(t):
    return t.events.select("event_id", X.safe_int(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.col("event_type"))).alias("n"))


def _overlap(docs: DataFrame) -> DataFrame:
    c = docs.select("doc_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    r = c.where("doc_id = 0").select("w", F.col("n").alias("m"))
    return c.join(r, "w", "left").groupBy("doc_id").agg(F.round(F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n"), 6).alias("p"))


_OVERLAP = r"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(trim(text), '\s+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT w, n FROM c WHERE doc_id = 0) SELECT c.doc_id, round(sum(least(c.n, coalesce(r.n, 0)))::DOUBLE / sum(c.n), 6) AS p FROM c LEFT JOIN r USING (w) GROUP BY 1"


@query("ngram_overlap", _OVERLAP)
@query("ngram_overlap_all", _OVERLAP)
def ngram_overlap(t):
    """Clipped unigram precision of all documents against document 0."""
    return _overlap(t.documents)


@query("mask_labels", """WITH p AS (SELECT conv_id, min(text) FILTER (turn = 0) AS u, min(text) FILTER (turn = 1) AS a FROM conversations GROUP BY 1),
k AS (SELECT *, least(length(u), 512 - length(a)) AS keep FROM p WHERE u IS NOT NULL AND a IS NOT NULL AND length(a) < 512 AND length(a) > 0 AND length(u) > 0)
SELECT conv_id, (keep + length(a))::INT AS n, keep::INT AS masked, list_sum(list_transform(string_split(right(u, keep) || a, ''), lambda c: unicode(c)))::BIGINT AS sum_ids FROM k""")
def mask_labels_query(t):
    p = t.conversations.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("u"), F.min(F.when(F.col("turn") == 1, F.col("text"))).alias("a"))
    chars = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    made = p.where("length(u) > 0 and length(a) > 0").select("conv_id", mask_labels(chars("u"), chars("a"), 512).alias("m")).where("m is not null")
    return made.select("conv_id", F.size("m.input_ids").alias("n"), F.size(F.filter("m.labels", lambda x: x == -100)).alias("masked"), F.aggregate("m.input_ids", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("sum_ids"))


@query("dq_counts", " UNION ALL ".join(f"SELECT '{k}' AS rule, {n} AS n, {ok} AS ok FROM {src}" for k, n, ok, src in (
    ("documents 24 to 32", "count(*)", "count(*) BETWEEN 24 AND 32", "documents"), ("benchmark at least 8", "count(*)", "count(*) >= 8", "benchmark"), ("conversations exactly 50", "count(DISTINCT conv_id)", "count(DISTINCT conv_id) = 50", "conversations"))) + " UNION ALL SELECT 'source ' || source || ' exactly 10', count(*), count(*) = 10 FROM documents GROUP BY source")
def dq_counts(t):
    """Sizes of task lists: between two bounds, at least, exactly, and exactly so many in each category."""
    rule = lambda df, name, n, ok: df.agg(n.alias("n")).select(F.lit(name).alias("rule"), "n", ok(F.col("n")).alias("ok"))
    a = rule(t.documents, "documents 24 to 32", F.count("*"), lambda n: n.between(24, 32))
    b = rule(t.benchmark, "benchmark at least 8", F.count("*"), lambda n: n >= 8)
    c = rule(t.conversations, "conversations exactly 50", F.count_distinct("conv_id"), lambda n: n == 50)
    each = t.documents.groupBy("source").agg(F.count("*").alias("n")).select(F.concat(F.lit("source "), F.col("source"), F.lit(" exactly 10")).alias("rule"), "n", (F.col("n") == 10).alias("ok"))
    return a.unionByName(b).unionByName(c).unionByName(each)


@query("dq_snake_case", "SELECT source, regexp_matches(source, '^[a-z][a-z0-9_]*$') AS ok FROM documents GROUP BY 1, 2")
def dq_snake_case(t):
    return t.documents.select("source", F.col("source").rlike("^[a-z][a-z0-9_]*$").alias("ok")).distinct()


def missing_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """(field, n_missing): rows in which a required field is null or empty, or is no column at all; in one pass."""
    lacks = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) if c in df.columns else F.lit(True)
    counted = df.agg(*[F.count_if(lacks(c)).alias(c) for c in required])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing")) for c in required])).alias("x")).select("x.*")


@query("dq_fields", "SELECT 'doc_id' AS field, count_if(doc_id IS NULL)::BIGINT AS n_missing FROM documents UNION ALL SELECT 'text', count_if(coalesce(trim(text), '') = '')::BIGINT FROM documents UNION ALL SELECT 'difficulty', count(*) FROM documents")
def dq_fields(t):
    return missing_fields(t.documents, ["doc_id", "text", "difficulty"])


@query("dq_domain", "SELECT count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) AS bad_lang, count(*) FILTER (length(trim(text)) <= 20) AS short_text, count(*) FILTER (source IS NULL) AS no_source FROM documents")
def dq_domain(t):
    return t.documents.agg(F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("bad_lang"), F.count_if(F.length(F.trim("text")) <= 20).alias("short_text"), F.count_if(F.col("source").isNull()).alias("no_source"))