"""Style trees: a plain version on planted hosts, names with words of noise, broken markup, odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from tessera.llm import style_tree
from tessera.llm.style_tree import collapse, main_text, parse

SCHEMA = "page_id bigint, url string, html string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def plain_mark(page):
    leaves = [x for x in (x.strip(" ") for x in re.split("<[^>]*>", re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)", " ", page))) if x]
    return tuple(x for x in leaves if len(x) * len(leaves) >= sum(map(len, leaves)))


def plain_low(pages):
    """Paths of low importance by the definitions, from all pages of a host at once: recursive, without counts. Of prints
    of one page, which are equal here, the first is taken."""
    pages = list({plain_mark(p): p for p in reversed(pages)}.values())
    nodes = [[n for n in parse(p)[0][1:] if not n.hidden] for p in pages]
    kids, shapes, texts, on, word = defaultdict(set), defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), defaultdict(set), {}
    for i, page in enumerate(nodes):
        for path, shape in {(n.path, "|".join(a for a, b in zip(n.children, [None, *n.children]) if a != b)) for n in page}:
            shapes[path][shape] += 1  # the pages that show this child sequence
        for n in page:
            kids[n.parent.path].add(n.path)
            on[n.path].add(i)
            word[n.path] = n.worded
            if t := collapse("".join(n.text)):
                texts[n.path][t][i] += 1
    entropy = lambda counts, base: -sum(c / sum(counts) * math.log(c / sum(counts), base) for c in counts)
    known = lambda path: sum(shapes[path].values()) > 1

    def judge(path):
        """(importance, best of it and all below)"""
        m = sum(shapes[path].values())
        below = [p for p in kids[path] if known(p)]
        inner = [(judge(p)[0], sum(shapes[p].values())) for p in below]
        content = None
        if texts[path]:
            total = sum(sum(c.values()) for c in texts[path].values())
            content = 1 - min(1, sum(sum(c.values()) * entropy(list(c.values()), m) for c in texts[path].values()) / total)
            inner.append((content, m))
        mean = sum(a * b for a, b in inner) / sum(b for _, b in inner) if inner else 0
        share = 0.9 ** len(shapes[path])
        own = (1 - share) * entropy(list(shapes[path].values()), m) + share * mean if below else mean
        best = (max(own, content or 0) * m + style_tree.PRIOR) / (m + style_tree.PRIOR + word[path] * style_tree.WORD_PRIOR)
        return own, max([best, *(judge(p)[1] for p in below)])

    out = set()

    def walk(path):
        if known(path) and judge(path)[1] < style_tree.LEAST_IMPORTANCE:
            out.add(path)
        elif known(path):
            for p in kids[path]:
                walk(p)

    for p in list(kids[0]):
        walk(p)
    return out


def planted(rng, n):
    """Pages of a site without article or main: a menu, a share box and a notice are alike, stories and asides differ."""
    out = []
    for i in range(n):
        box = f"<div class=share><p>Send to friends</p><p>{rng.choice(['Now', 'Later'])}</p></div>" if i % 3 else ""
        story = "".join(f"<p>{sentence(rng, 12)}</p>" for _ in range(rng.randint(1, 4)))
        out.append(f"<body><div class=top><ul><li>Home</li><li>News</li></ul></div><div class=story>{story}<div class=legal-info>All rights</div></div>{box}<div class='more m{i}'><b>{sentence(rng, 3)}</b></div></body>")
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 12, 40])
def test_tree_against_a_plain_version(spark, n):
    rng = random.Random(n)
    hosts = {"a.example": planted(rng, n), "b.example": planted(rng, n + 1)}
    rows = [(f"http://{h}/{i}", h, p) for h, ps in hosts.items() for i, p in enumerate(ps)]
    got = {r.host: set(r.low) for r in style_tree.style_trees(spark.createDataFrame(rows, "url string, host string, html string").repartition(3)).collect()}
    for h, ps in hosts.items():
        assert got.get(h, set()) == plain_low(ps)


def test_the_tree_alone_finds_the_text(spark):
    rng = random.Random(1)
    pages = planted(rng, 30)
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    out = style_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in out:
        assert not any(w in r.text for w in ("Home", "News", "friends", "All rights"))
        assert len(r.text.split()) % 12 == 3
        # Without the tree the menu and the notice would stay.
        assert "Home" in main_text(pages[r.page_id], set()) and "All rights" in main_text(pages[r.page_id], set())


def test_a_word_of_noise_beside_others_is_judged_by_the_tree(spark):
    rng = random.Random(2)
    assert main_text('<article><p>one</p><p class="related-work">real section</p><p class="legal-notice">real two</p></article>', set()) == "one real section real two"
    assert main_text('<article><p>one</p><div class="ad ad-3">x</div><div class="cookie-notice">y</div><div id=post-comments>z</div></article>', set()) == "one"
    page = "<article><p>{}</p><p class=related-work>{}</p><p class=author-notice>{}</p></article>"
    rows = [(i, f"http://h.example/{i}", page.format(sentence(rng, 9), sentence(rng, 5), rng.choice("ab"))) for i in range(20)]
    assert all(len(r.text.split()) == 14 for r in style_tree.extract(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p class="x"">first words here</p><p>second "quoted words</p><p>third</p>', 'first words here second "quoted words third'),
        ("<p title='a > b'>x</p>", "x"),
        ("<p class=\"a'b\">x</p><p data-x='>y", "x y"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>one<p>two</div></b>three<", "one two three<"),
        ("<p a=\"1\" b='2' c=3 d>x", "x"),
        ("<script>if (a < b) {}</script>x<script>never closed", "x"),
        ("&lt;b&gt; &#65;&#x42; &nbsp; end", "<b> AB end"),
    ],
)
def test_broken_markup(html, text):
    assert main_text(html, set()) == text


def test_huge_page_and_deep_nesting():
    assert len(main_text("<p>word " * 100_000, set()).split()) == 100_000
    assert main_text("<div>" * 20_000 + "x" + "</div>" * 20_000, set()) == "x"
    assert main_text("<p " + "a= " * 50_000 + ">x", set()) == "x"


def test_odd_tables(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string, host string, low string, text string")
    assert style_tree.extract(df).count() == 0
    rows = [(1, "http://h/1", "<p>x", "a", "b", "c"), (1, "http://h/1", "<p>x", "a", "b", "c"), (None, None, None, None, None, None), (2, "http://h/2", "", "a", "b", "c")]
    out = style_tree.extract(spark.createDataFrame(rows, df.schema)).collect()
    assert len(out) == 4 and [r.text for r in out if r.page_id == 1] == ["x", "x"]
    assert {r.page_id: r.text for r in out}[None] == "" and {r.page_id: r.text for r in out}[2] == ""


def texts(spark, pages):
    rows = [(i, u, p) for i, (u, p) in enumerate(pages)]
    return [r.text for r in sorted(style_tree.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=lambda r: r.page_id)]


@pytest.mark.parametrize("n", [2, 3, 20, 60])
@pytest.mark.parametrize("article", ["article", "div"])
def test_prints_of_one_page_lose_nothing(spark, n, article):
    rng = random.Random(n)
    title, body = sentence(rng, 6), sentence(rng, 40)
    page = f"<body><{article}><h1>{title}</h1><p>{body}</p></{article}></body>"
    counted = f"<body><{article}><h1>{title}</h1><p>{body}</p><p>Seen {{}} times</p></{article}></body>"
    assert texts(spark, [(f"http://h.example/1?utm={i}", page) for i in range(n)]) == [f"{title} {body}"] * n
    assert texts(spark, [(f"http://h.example/1?utm={i}", counted.format(i)) for i in range(n)]) == [f"{title} {body} Seen {i} times" for i in range(n)]
    assert texts(spark, [(None, page) for _ in range(n)]) == [f"{title} {body}"] * n


def test_two_page_hosts_and_pages_without_a_host_keep_their_text(spark):
    rng = random.Random(8)
    bodies = [sentence(rng, 12) for _ in range(6)]
    page = "<body><p>Same line on both</p><p>{}</p></body>".format
    urls = ["http://a.example/1", "http://a.example/2", None, None, "no host", "http://b.example"]
    assert texts(spark, [(u, page(b)) for u, b in zip(urls, bodies)]) == [f"Same line on both {b}" for b in bodies]


def test_mirrors_beside_other_pages_against_the_plain_version(spark):
    rng = random.Random(9)
    pages = planted(rng, 25)
    mirrored = pages + [pages[0]] * 30 + [pages[3]] * 2
    rows = [(f"http://a.example/{i}", "a.example", p) for i, p in enumerate(mirrored)]
    low = {r.host: set(r.low) for r in style_tree.style_trees(spark.createDataFrame(rows, "url string, host string, html string").repartition(3)).collect()}
    assert low["a.example"] == plain_low(mirrored) == plain_low(pages) != set()


def test_an_article_keeps_what_the_tree_would_take_most_of(spark):
    rng = random.Random(10)
    pages = [f"<body><article><p class=a>{sentence(rng, 3)}</p><div class=b><p>All of this stands on every page of the site, and it is long</p></div></article></body>" for _ in range(30)]
    assert all(t.endswith("it is long") for t in texts(spark, [(f"http://h.example/{i}", p) for i, p in enumerate(pages)]))
