"""Language identification against one text, one machine and one n-gram at a time; odd tables."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tessera.llm import language

LETTERS = {"en": "etaoinshrdlu", "de": "enisratdhußä", "fr": "esaitnrulodé", "es": "eaosrnidltcñ", "ru": "оеаинтсрвлкм", "el": "αοιετσνηυρπκ", "xx": "zqxjkvbpwygf"}
SCHEMA = "doc_id bigint, text string, lang string, lang_pred int, score string, x int"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 40), lang, 1, "s", 2) for i, lang in enumerate(sorted(LETTERS) * 30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return language.train(docs, "doc_id", "text", "lang", language.remainder("doc_id") != 2, per_lang=20)


def plain_frequencies(raw: bytes):
    counts = [0.0] * language.SLOTS
    for i in range(len(raw) - 2):
        grams = raw[i], raw[i] | raw[i + 1] << 8 | 1 << 24, raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 | 2 << 24
        for g in grams:
            counts[(g * 2654435761 % (1 << 32)) >> 20] += 1
    return [c / max(1, sum(counts)) for c in counts]


def plain_prediction(model, s):
    """(language, score) by definition: machines vote in pairs, ties go by the sum of margins."""
    raw = language.letters(s)
    if not raw:
        return "und", 0.0
    z = [(f - m) * w / math.sqrt(language.SLOTS) for f, m, w in zip(plain_frequencies(raw), model.mean.tolist(), model.scale.tolist())]

    def contest(group, n):
        if n == 1:
            return 0, 1.0
        pairs, weights = model.groups[group]
        margin = {}
        for (i, j), w in zip(pairs, weights.tolist()):
            m = sum(a * b for a, b in zip(z, w)) + w[-1]
            margin[i, j], margin[j, i] = m, -m
        votes = [sum((margin[i, j] > 0) if i > j else (margin[j, i] <= 0) for j in range(n) if j != i) for i in range(n)]
        best = max(range(n), key=lambda i: votes[i] + math.tanh(sum(margin[i, j] for j in range(n) if j != i)) / 4)
        least = min(margin[best, j] for j in range(n) if j != best)
        return best, 1 / (1 + math.exp(-3 * max(-50, min(50, least))))

    family, sure = contest(0, len(model.families))
    members = model.members[family]
    lang, within = contest(family + 1, len(members))
    return members[lang], sure * within


def test_against_plain_machines(spark, fitted):
    rng = random.Random(3)
    texts = [text(rng, lang, n) for lang in LETTERS for n in (1, 3, 30)] + ["", None, "12 !", "a", "É" * 50, " \n", text(rng, "en", 10) + " " + text(rng, "ru", 10)]
    docs = spark.createDataFrame([(i, t, None, 1, "s", 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = language.identify(docs, fitted).collect()
    assert len(out) == len(texts)
    for r in out:
        lang, score = plain_prediction(fitted, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_families_are_told_apart(fitted):
    rng = random.Random(4)
    assert fitted.families == sorted({language.FAMILY.get(c, "other") for c in LETTERS})
    right = [fitted.predict(language.frequencies([language.letters(text(rng, c, 30))]))[0][0] == c for c in LETTERS for _ in range(5)]
    assert sum(right) >= 0.95 * len(right)


def test_long_texts_and_odd_tables(spark, fitted):
    rng = random.Random(5)
    long = text(rng, "de", 400_000)
    rows = [(1, long, None, 1, "s", 2), (1, long, None, 1, "s", 2), (None, text(rng, "fr", 40), "de", 1, "s", 2)]
    out = language.identify(spark.createDataFrame(rows, SCHEMA), fitted)
    assert sorted(((r.doc_id, r.lang_pred) for r in out.collect()), key=repr) == [(1, "de"), (1, "de"), (None, "fr")]
    assert out.columns.count("lang_pred") == out.columns.count("score") == 1 and dict(out.dtypes)["score"] == "double"
    assert language.identify(spark.createDataFrame([], SCHEMA), fitted).count() == 0
    assert language.train(spark.createDataFrame(rows, SCHEMA).where("lang is null"), "doc_id", "text", "lang", language.remainder("doc_id") >= 0) is None


def test_rows_without_ids_send_a_bounded_sample(spark):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    rows = [(None, f"{word('abcde')} {word('abcde')}", "en") for _ in range(3000)] + [(None, f"{word('uvwxy')} {word('uvwxy')}", "de") for _ in range(30)]
    rows += [(7, "the same text", "en")] * 2000
    df = spark.createDataFrame(rows, "id bigint, text string, lang string").repartition(4)
    draws = language.smallest_draws(df.select("lang", F.xxhash64("id", "text").alias("draw")), 20)
    assert {r["lang"]: r["count"] for r in draws.groupBy("lang").count().collect()} == {"en": 20, "de": 20}
    model = language.train(df, "id", "text", "lang", F.lit(True), 20)
    judged = language.identify(df.limit(0).union(df.where("lang = 'de'")), model)
    assert {r.lang_pred for r in judged.collect()} == {"de"}
