"""Thresholds of quality rules: a large group's own take effect, on Spark and in SQL alike."""

import random
from collections import Counter

import duckdb
import pytest
from tessera.llm import quality


def rows(rng):
    """Two sources of one language: in one, symbols are common; a third, small one has a text of either kind."""
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    noisy = lambda n: words(n).replace(" ", "# ")
    out = [("en", "code", noisy(60)) for _ in range(100)] + [("en", "prose", words(60)) for _ in range(1500)]
    out += [("en", "code", noisy(60)), ("en", "prose", noisy(60)), ("en", "few", words(60)), (None, None, words(60)), ("en", None, None), (None, "prose", "")]
    return [(i, t, lang, source) for i, (lang, source, t) in enumerate(out)]


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("quality") / "documents.parquet")
    df = spark.createDataFrame(rows(random.Random(3)), "doc_id bigint, text string, lang string, source string")
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(quality.OP9_SQL)
    columns = [c[0] for c in want.description]
    return quality.quality_rules(spark.read.parquet(path)).select(*columns).collect(), want.fetchall()


def test_sql_twin_on_large_groups(judged):
    got, want = judged
    assert Counter(map(tuple, got)) == Counter(want)


def test_own_thresholds_take_effect(judged):
    kept = {r.doc_id: r.kept for r in judged[0]}
    # The same kind of text, common in one source and odd in the other; by its language's thresholds it would stay.
    assert kept[1600] and not kept[1601]
    assert sum(kept[i] for i in range(1600)) >= 1580
    assert not kept[1604] and not kept[1605]
