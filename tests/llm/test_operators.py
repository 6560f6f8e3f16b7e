"""Small odd inputs for every operator, and brute force where SQL can't express it."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Row
from tessera.llm import exact_dedup, language, near_dedup, quality, registry, style_tree, substring_dedup

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """rows of (doc_id, text); lang and source have nulls, and there are columns that operators use as names."""
    full = [(i, t, None if k % 3 == 0 else "en", None if k % 2 else "src", 1, "x", True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_removed int, digest string, kept boolean").repartition(3)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()) + str(rng.randint(0, 99)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "a"), (5, "a"), (None, "a b"), (None, None), (6, "a b\tc"), (7, "ab c"), (8, "word " * 5000), (9, "日本語 é 🙂")]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(map(tuple, want.fetchall()))


def test_exact_dedup_odd(spark):
    rows = exact_dedup.exact_dedup(documents(spark, ODD), fan_in=2).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((i, t or ""))
    assert sum(r.kept for r in rows) == len(groups)
    for r in rows:
        members = next(m for k, m in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert (r.group_size, r.keep_id) == (len(members), best[0])


def test_exact_dedup_many_nodes(spark):
    rows = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(500)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(20), fan_in=2).where("kept").collect()
    assert {r.doc_id for r in out} == {min(range(500), key=lambda i: (i % 37 != k, -(i % 5), i)) for k in range(37)}


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, quality.quality_rules, substring_dedup.substring_dedup, near_dedup.near_dedup])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_quality_odd(spark):
    rows = quality.quality_rules(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_words, by[1].kept, by[1].base_failed) == (0, False, True)
    assert (by[8].n_words, by[8].n_repeat_words) == (5000, 5000)
    assert by[9].word_chars == 5


def test_substring_odd(spark):
    line = "this line has more than five words"
    rows = [(1, None), (2, ""), (3, f"{line}\nown words of the third text"), (4, f"x\n  THIS line has\tmore than five words \ny"), (4, f"x\n  THIS line has\tmore than five words \ny"), (None, line)]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark, rows), least_run=5).collect() if r.doc_id}
    assert out[1].text is None and out[2].text == "" and out[3].n_removed == 0
    assert out[4].text == "x\ny" and [(s.start, s.end) for s in out[4].removed] == [(2, 39)]


def plain_classes(texts, threshold):
    """Connected components of the pairs whose plain shingle similarity is clear of the threshold on the upper side."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, (t or "").split()) for i, t in texts) if w}
    label = {i: i for i, _ in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in label}


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(5)
    base = [sentence(rng, 150) for _ in range(6)]
    texts = []
    for k in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 9])):
            words[rng.randrange(len(words))] = f"edit{k}"
        texts.append((k, " ".join(words)))
    texts += [(200 + i, sentence(rng, rng.randint(1, 80))) for i in range(60)] + [(300, None), (301, ""), (302, "two words"), (303, "two  words")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(documents(spark, texts)).collect()}
    low, high = plain_classes(texts, 0.76), plain_classes(texts, 0.84)
    for i in got:
        for j in got:
            if high[i] == high[j]:
                assert got[i] == got[j]
            if got[i] == got[j]:
                assert low[i] == low[j]
    assert got[302] == got[303] == 302 and got[300] == 300 and got[301] == 301


def test_language_held_out(spark):
    rows = language.op4_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(spark):
    docs = documents(spark, ODD)
    model = language.train(docs, "doc_id", "text", "lang", language.remainder("doc_id") != 2)
    got = language.identify(docs, model).collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert language.train(documents(spark, []), "doc_id", "text", "lang", language.remainder("doc_id") != 2) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


PAGE = "<html><head><title>no</title><style>p{}</style></head><body><nav>menu</nav><div class='cookie-notice'>ok?</div>{}<footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n  two<br>three</p></article>", "A & B one two three"),
        ("<p>no <b>ar</b>ticle<p>here", "no article here"),
        ("<article><p>x</p><section class='comments'><p>bad</p></section><form>f</form></article><p>outside</p>", "x"),
        ("<article><script>var a='</p>';</script><p>a<!-- gone -->b</article>", "ab"),
        ("", ""),
    ],
)
def test_main_text(body, text):
    assert style_tree.main_text(PAGE.replace("{}", body), set()) == text


def test_style_tree_finds_what_repeats(spark):
    rng = random.Random(1)
    rows = [Row(page_id=i, url=f"http://h.example/{i}", html=f"<body><div class=top>same words all over</div><div class=story><p>{sentence(rng, 30)}</p></div></body>") for i in range(20)]
    rows += [Row(page_id=100, url=None, html=None), Row(page_id=None, url="x", html="<p>t"), Row(page_id=101, url="http://one.example", html="<div class=top>alone</div>")]
    out = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert "same words" not in out[3] and len(out[3].split()) == 30
    assert (out[100], out[None], out[101]) == ("", "t", "alone")


def test_low_branches_go_inside_the_article(spark):
    rng = random.Random(2)
    page = "<body><main><article><div class=box><ul><li>Send to friends</li></ul></div><p>{} <em>same</em> end</p></article></main></body>"
    rows = [Row(page_id=i, url=f"http://h.example/{i}", html=page.format(sentence(rng, 30))) for i in range(20)]
    rows += [Row(page_id=100 + i, url=f"http://g.example/{i}", html="<article><p>one text</p></article>") for i in range(10)]
    out = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("friends" not in out[i] and out[i].endswith(" same end") and len(out[i].split()) == 32 for i in range(20))
    assert all(out[100 + i] == "one text" for i in range(10))


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('<div class="content no-sidebar"><article><p>x</p></article></div>', "x"),
        ('<div id="page" class="has-sidebar"><main><section class="post with-comments"><article>x</article></section></main></div><p>y', "x"),
        ('<div class="page-header"><main>x</main></div>', "x"),
        ('<div class="with-sidebar"><article>x<div class="comments"><article>c</article></div></article><div class="comments"><article>c</article></div></div>', "x"),
        ('<main><article>x</article><div class="related"><article>c</article></div></main>', "x"),
        ('<div class="sidebar"><p>c</p></div><p>x', "x"),
        ('<aside><article>c</article></aside><p>x', "x"),
    ],
)
def test_class_words_spare_what_holds_the_article(body, text):
    assert style_tree.main_text(PAGE.replace("{}", body), set()) == text
