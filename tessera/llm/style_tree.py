"""Main text of web pages by site style trees.

The pages of one host are merged into a tree of style nodes: a node is a path of elements, each known by its tag, class
and id (digits taken as one). A node's presentation importance is the entropy of the child sequences that it has over
its pages; a leaf's content importance is one minus the mean normalised entropy, over pages, of the texts found there.
Importance is composed from the leaves up. Branches of low importance are menus, notices, adverts and the like, which
look and read alike all over a site, and are removed from each page first.

Pages of a host that share what most of their text is (their leaves of mean length or more) are prints of one page, such
as one under several addresses or with another counter, and count as one. Nothing is known from a few pages: a node's
importance is drawn toward one by PRIOR pages on which it would have differed.

Roles come after that, for what a tree can't tell: elements whose tag says that they are never main text (a page's own
links in a nav, forms) or whose class, id or role is nothing but words of noise ("cookie-notice"), reader comments,
which differ on every page, and on a page with an article what lies outside. A name that has a word of noise beside
others ("related-work") removes nothing: it counts as WORD_PRIOR pages on which the branch looked alike, and the tree
decides. A node that only one page of its host has is important.

Executors emit counts per node and feature, which Spark adds up; only the finished trees' low branches, a short list
for each host, travel back to the pages.
"""

import html as entities
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, small_batches, stored, table

LEAST_IMPORTANCE = 0.5
#: Pages that every node has had, on which it differed; and that a class or id word counts for, on which its branch
#: looked alike. So a branch that is the same on all pages goes from the seventh page on, one with such a word from the third.
PRIOR, WORD_PRIOR = 6, 4
#: Weight of a node's descendants in its importance, as in the published method.
GAMMA = 0.9
#: Element roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that show no text of the page, and those whose role is never main text.
HIDDEN = set("head script style noscript iframe template button select option textarea input svg canvas object embed audio video title".split())
ROLES = set("nav footer aside form dialog menu".split())
MAIN = {"article", "main"}
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
COMMENT_WORDS = set("comment comments discussion respond replies reply disqus".split())
PRIOR_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login social share sharing related recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead pagination pager toolbar".split()
)
#: Roles that are noise outside the article only.
OUTER_NOISE = {"header"}

#: A quote opens a value only after an equals sign; any other is a character like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """hidden: shows no text; noise: hidden, or a role that is never main text; named: its name says noise; worded: has, or
    lies in one that has, a word of noise beside others. All but named also hold for what is below."""

    __slots__ = ("tag", "path", "parent", "hidden", "noise", "named", "worded", "main", "children", "text")

    def __init__(self, tag, path, parent, hidden, noise, named, worded, main):
        self.tag, self.path, self.parent, self.hidden, self.noise, self.named, self.worded, self.main = tag, path, parent, hidden, noise, named, worded, main
        self.children: list[str] = []
        self.text: list[str] = []


def path_of(parent: int, signature: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{signature}".encode()) >> 1


def noise_name(value: str) -> tuple[bool, bool]:
    """(says noise, has a word of noise): of a class, id or role."""
    sure = some = False
    for name in value.split():
        found = [w for w in SPLIT.split(name) if w and not w.isdigit()]
        noisy = [w for w in found if w in PRIOR_WORDS]
        sure = sure or bool(COMMENT_WORDS.intersection(found)) or bool(found) and len(noisy) == len(found)
        some = some or bool(noisy)
    return sure, some


def parse(page: str):
    """(nodes, runs): the element nodes, and the page's text as (node, text) with (node, None) at block boundaries."""
    root = Node("", 0, None, False, False, False, False, False)
    stack, nodes, runs, at = [root], [root], [], 0
    signatures: dict[str, tuple[str, bool, bool, bool, bool, bool, bool]] = {}

    def add(text: str) -> None:
        if text:
            stack[-1].text.append(text)
            runs.append((stack[-1], text))

    def pop_to(tag: str, stops: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        closing, tag, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3)
        if not tag:
            continue
        if tag not in INLINE:
            runs.append((stack[-1], None))
        if closing:
            pop_to(tag, set())
            continue
        if tag in CLOSES_P:
            pop_to("p", {"button", "table", "td", "th"})
        if tag in ITEMS:
            pop_to(tag, ITEMS[tag])
        key = tag + attrs if attrs else tag
        if key not in signatures:
            found = {a.lower(): (x or y or z).lower() for a, x, y, z in NAMED.findall(attrs)} if attrs else {}
            words = {w for v in found.values() for w in SPLIT.split(v)}
            plain = tag not in ("html", "body", *MAIN)
            judged = [noise_name(v) for v in found.values()] if plain else []
            name = tag + "." + re.sub(r"\d+", "0", found.get("class", "") + "#" + found.get("id", ""))
            signatures[key] = name, tag in HIDDEN, tag in ROLES, any(x for x, _ in judged), any(x for _, x in judged), tag in OUTER_NOISE, bool(words & OUTER_NOISE)
        signature, hidden, role, sure, some, outer, outer_named = signatures[key]
        parent = stack[-1]
        parent.children.append(signature)
        main = parent.main or tag in MAIN
        hidden = parent.hidden or hidden
        noise = hidden or parent.noise or role or (outer and not main)
        node = Node(tag, path_of(parent.path, signature), parent, hidden, noise, sure or (outer_named and not main), parent.worded or (some and not sure), main)
        nodes.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in INLINE | CLOSES_P:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(page, at)
            text, at = page[at : end.start()], end.start()
            stack.append(node)
            if not node.hidden:
                add(text)
            stack.pop()
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        stack.append(node)
    add(page[at:])
    settle_names(nodes)
    return nodes, runs


def settle_names(nodes: list[Node]) -> None:
    """Adds to noise what class, id and role words say: an element that they name goes with all below, unless it holds
    the page's article.

    That is the outermost article, or a main without one; of several, those below the fewest named elements, so that
    comments or teasers marked up as articles don't count beside it.
    """
    holds, inside = set(), set()  # nodes above an article, articles and nodes below one
    for n in nodes:
        if n.tag == "article" or n.parent in inside:
            inside.add(n)
        if n.tag == "article" and not n.noise:
            up = n.parent
            while up is not None and up not in holds:
                holds.add(up)
                up = up.parent
    depth: dict[Node, int] = {}
    for n in nodes:
        depth[n] = (depth[n.parent] if n.parent is not None else 0) + n.named
    found = [n for n in nodes if n.tag in MAIN and not n.noise and n.parent not in inside and (n.tag == "article" or n not in holds)]
    least = min((depth[n] for n in found), default=0)
    for n in found:
        if depth[n] == least:
            while n is not None and depth[n]:
                n.named = False
                n = n.parent
    for n in nodes:  # parents come first
        n.noise = n.noise or n.named or n.parent is not None and n.parent.noise


def collapse(text: str) -> str:
    return " ".join(text.split())


def main_text(page: str | None, low: set[int], roles: bool = True) -> str:
    """The page's text without low branches and, with roles, without elements that are never main text.

    With an article or main only what is in it counts. Low branches go there too, but an inline element is part of its
    sentence and goes only with its block, and a page that would lose half its main text or more to them keeps it.
    Without roles the style tree alone decides, but for elements that show no text.
    """
    nodes, runs = parse(page or "")
    mains = [n for n in nodes if n.tag in MAIN and not n.noise] if roles else []
    guarded = set()
    for n in mains:
        while n is not None and n not in guarded:
            guarded.add(n)
            n = n.parent

    def left(low: set[int]) -> str:
        gone: dict[Node, bool] = {}
        for n in nodes:  # parents come first
            by_tree = n.path in low and n not in guarded and not (n.main and n.tag in INLINE)
            by_role = roles and (n.noise or bool(mains) and n not in guarded and not n.main)
            gone[n] = n.hidden or n.parent is not None and gone[n.parent] or by_tree or by_role
        return collapse("".join(" " if text is None else "" if gone[n] else entities.unescape(text) for n, text in runs))

    text = left(low)
    if mains and low:
        whole = left(set())
        text = text if 2 * len(text) > len(whole) else whole
    return text


def counts(page: str | None):
    """(path, parent, worded, kind, feature) -> times of one page: kind p for presentation, c for content."""
    nodes, _ = parse(page or "")
    seen: Counter = Counter()
    for n in nodes[1:]:
        if n.hidden:
            continue
        shape = [a for a, b in zip(n.children, [None, *n.children]) if a != b]
        key = n.path, n.parent.path, n.worded
        seen[*key, "p", xxhash.xxh3_64_intdigest("|".join(shape).encode()) >> 1] += 1
        text = collapse(entities.unescape("".join(n.text)))
        if text:
            seen[*key, "c", xxhash.xxh3_64_intdigest(text.encode()) >> 1] += 1
    return seen


def low_branches(tree: pd.DataFrame) -> list[int]:
    """The topmost paths of one host's tree that are of low importance, composed of their own and their children's, as
    are all paths below them."""
    children: dict[int, list[int]] = {}
    info = {}
    for r in tree.itertuples(index=False):
        info[r.path] = r
        children.setdefault(r.parent, []).append(r.path)
    importance: dict[int, float] = {}
    best: dict[int, float] = {}
    order, todo = [], [p for p in info if info[p].parent not in info]
    while todo:
        p = todo.pop()
        order.append(p)
        todo += children.get(p, [])
    for p in reversed(order):
        r, below = info[p], [c for c in children.get(p, [])]
        parts = [(importance[c], info[c].pages) for c in below]
        if r.content == r.content:  # not NaN: it has text of its own
            parts.append((r.content, r.pages))
        inner = sum(v * n for v, n in parts) / sum(n for _, n in parts) if parts else 0.0
        share = GAMMA ** max(1, r.shapes)
        importance[p] = (1 - share) * r.presentation + share * inner if below else inner
        # A node's own text is a leaf: one that differs from page to page keeps its node, whatever children it has.
        own = max(importance[p], r.content if r.content == r.content else 0.0)
        believed = (own * r.pages + PRIOR) / (r.pages + PRIOR + WORD_PRIOR * r.worded)
        best[p] = max([believed, *(best[c] for c in below)])
    low, todo = [], [p for p in info if info[p].parent not in info]
    while todo:
        p = todo.pop()
        if best[p] < LEAST_IMPORTANCE:
            low.append(p)
        else:
            todo += children.get(p, [])
    return sorted(low)


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)"


def prints(pages: DataFrame) -> DataFrame:
    """pages with _share: one divided by the number of its host's pages that share the leaves of mean length or more."""
    shown = F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    leaves = F.filter(F.transform(F.split(shown, "<[^>]*>"), lambda x: F.trim(x)), lambda x: x != "")
    letters = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    mark = let(F.coalesce(leaves, F.array().cast("array<string>")), lambda xs: let(letters(xs), lambda n: F.xxhash64(F.filter(xs, lambda x: F.length(x) * F.size(xs) >= n))))
    marked = pages.withColumn("_mark", mark)
    copies = marked.groupBy("host", "_mark").agg(F.count("*").alias("_copies")).where("_copies > 1")
    return marked.join(copies, ["host", "_mark"], "left").withColumn("_share", 1 / F.coalesce("_copies", F.lit(1)))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, low): the low branches of every host that has some; pages has host and html."""

    def count(batches):
        for b in batches:
            rows: Counter = Counter()
            logs: Counter = Counter()
            at: Counter = Counter()
            for host, page, share in zip(b["host"].to_pylist(), b["html"].to_pylist(), b["_share"].to_pylist()):
                for key, n in counts(page).items():
                    rows[host, *key] += share * n
                    logs[host, *key] += share * n * math.log(n)
                    at[host, *key] += share
            if rows:
                keys = list(rows)
                columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[k] for k in keys], pa.float64()) for x in (rows, logs, at)]], ["host", "path", "parent", "worded", "kind", "feature", "times", "logs", "pages"])

    seen = prints(pages.select("host", "html")).select("host", "html", "_share").mapInArrow(count, "host string, path bigint, parent bigint, worded boolean, kind string, feature bigint, times double, logs double, pages double")
    key = ["host", "path", "parent", "worded", "kind"]
    by_feature = seen.groupBy(*key, "feature").agg(F.sum("times").alias("times"), F.sum("logs").alias("logs"), F.sum("pages").alias("pages"))
    by_feature = by_feature.withColumn("entropy", F.log("times") - F.col("logs") / F.col("times"))
    content, shape = F.col("kind") == "c", F.col("kind") == "p"
    node = by_feature.groupBy("host", "path", "parent", "worded").agg(
        F.sum(F.when(shape, F.col("pages"))).alias("pages"),
        F.count(F.when(shape, 1)).alias("shapes"),
        F.sum(F.when(shape, F.col("pages") * F.log("pages"))).alias("shape_logs"),
        F.sum(F.when(content, F.col("times") * F.col("entropy"))).alias("text_entropy"),
        F.sum(F.when(content, F.col("times"))).alias("texts"),
    )
    m = F.log("pages")
    # A node of one page has no entropy: it is important, as is what no tree knows.
    known = node.where(F.col("pages") > 1 + 1e-6).select(  # shares of one page add up to 1 but for rounding
        "host", "path", "parent", "worded", "pages", "shapes",
        F.round(1 - F.col("shape_logs") / (F.col("pages") * m), 9).alias("presentation"),
        F.round(1 - F.least(F.lit(1.0), F.col("text_entropy") / F.col("texts") / m), 9).alias("content"),
    )

    def judge(tree: pd.DataFrame) -> pd.DataFrame:
        low = low_branches(tree.sort_values("path"))
        return pd.DataFrame({"host": pd.Series([tree["host"].iloc[0]] * bool(low), dtype=object), "low": pd.Series([low] * bool(low), dtype=object)})

    # A group is one site's style paths that two pages or more share, however many pages it has.
    return known.groupBy("host").applyInPandas(judge, "host string, low array<bigint>")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page; text is empty if the page has none or html is null.

    Pages whose url is null or names no host form one site. Repeated pages are prints of one; null ids are kept, and
    rows that share an id each get a row; other columns are ignored, whatever their names; an empty df gives no rows.
    Broken markup is read as it comes: what a tag that never closes holds ends with the page.
    """
    small_batches(df.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    pages = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    trees = stored(style_trees(pages), "style-trees")

    def text(batches):
        for b in batches:
            out = [main_text(h, set(x or ())) for h, x in zip(b["html"].to_pylist(), b["low"].to_pylist())]
            yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array(out, pa.string())})

    # Small lists, one row a host; a host with a third of the pages is split by the adaptive skew join.
    joined = pages.join(trees, "host", "left")
    return joined.select("page_id", "url", "html", "low").mapInArrow(text, "page_id bigint, url string, text string")


def op10_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
