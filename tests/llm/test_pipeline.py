"""The corpus pipeline against what each stage must do to a few planted documents."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tessera.llm import byte_bpe

LINE = "this line is shared and, as shorter ones stay however often they stand in other texts, has more than twenty words of its own"


def own_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def planted(rng):
    """(rows, the texts that stay by doc_id)"""
    stay = {i: own_words(rng, 60) for i in range(20)}
    rows = list(stay.items())
    copy = own_words(rng, 50)
    rows += [(100, copy), (101, copy.replace(" ", "  ", 1)), (102, copy.replace(" ", "\t"))]
    stay[101] = copy.replace(" ", "  ", 1)  # the longest of equal texts
    near = own_words(rng, 120).split()
    rows += [(110, " ".join(near)), (111, " ".join([*near[:60], "changed", *near[61:]]))]
    stay[110] = " ".join(near)
    one, two = own_words(rng, 30), own_words(rng, 30)
    rows += [(120, f"{one}\n{LINE}"), (121, f"{LINE}\n{two}")]
    stay[120], stay[121] = f"{one}\n{LINE}", two
    rows += [(130, None), (131, ""), (132, "123 456 !")]
    return rows, stay


def test_every_stage_takes_effect(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, stay = planted(random.Random(3))
    full = [(i, t, "en" if i % 2 else "de", None, len(t or ""), "x", True) for i, t in rows]
    documents = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept boolean")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(stay)
    tokenizer = Tokenizer.from_file(byte_bpe.default_path())
    for doc_id, text in stay.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    alone, twice, other = own_words(rng, 60), own_words(rng, 60), own_words(rng, 60)
    near = own_words(rng, 120).split()
    changed = " ".join([*near[:60], "changed", *near[61:]])
    rows = [(None, alone), (1, twice), (1, twice), (2, other), (2, own_words(rng, 60)), (None, " ".join(near)), (3, changed)]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    by = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    unique = corpus_pipeline.drop_copies(spark, docs, None)
    assert by(unique) == sorted(set(rows), key=repr)
    left = corpus_pipeline.drop_near_copies(spark, unique, None)
    assert by(left) == sorted({(i, t) for i, t in rows if t != " ".join(near)}, key=repr)
    tokenizer, want, got = Tokenizer.from_file(byte_bpe.default_path()), Counter(), Counter()
    for i, text in by(left):
        want[i] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    for p in corpus_pipeline.pack(spark, left, None).collect():
        got[p.doc_id] += p.length
    assert got == want
