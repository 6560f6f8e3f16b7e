"""Token files, piece encoding and packing against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from tessera.llm import byte_bpe, packing, piece_bpe, repair_store

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  two  spaces ", "line\nbreak\r\n\tx", "<|endoftext|> in text", "日本語 🙂 é", "▁mark ▁▁", "it's 's", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD)] + [(3, "a", "again"), (3, "a", "again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)


def library_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(byte_bpe.default_path()).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_file_round_trip(spark, odd, tmp_path):
    path = f"file://{tmp_path}/shards"
    repair_store.write_ids(odd, path, byte_bpe.default_path(), shard_ids=50)
    got = sorted((r.doc_id, r.start, r.ids) for r in repair_store.read_ids(spark, path).collect())
    want, at = [], 0
    for i, t in sorted([(i, t) for i, t in enumerate(ODD)] + [(3, "a")] * 2, key=lambda x: x[0]):
        ids = library_ids(t)
        want.append((i, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(a, b, bytes(c)) for a, b, c in got] == want


def test_token_file_null_id(spark, tmp_path):
    """Rows without an id come last; each keeps its text."""
    path, rows = f"file://{tmp_path}/s", [(None, "x"), (7, "seven"), (None, "y z"), (2, None)]
    repair_store.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, byte_bpe.default_path(), shard_ids=3)
    got = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in repair_store.read_ids(spark, path).collect()), key=lambda r: r[1])
    ids = lambda t: np.array(library_ids(t), "<u4").tobytes()
    assert [r[0] for r in got] == [2, 7, None, None]
    assert [r[2] for r in got][:2] == [ids(""), ids("seven")] and {r[2] for r in got[2:]} == {ids("x"), ids("y z")}
    assert [r[1] for r in got] == list(np.cumsum([0] + [len(r[2]) // 4 for r in got])[:-1])


def test_token_file_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    repair_store.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), path, byte_bpe.default_path())
    assert repair_store.read_ids(spark, path).count() == 0


@pytest.mark.parametrize("kind", ["random", "runs", "period", "one", "none"])
def test_repair_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {"random": rng.integers(0, 9, 5000), "runs": np.repeat(rng.integers(0, 3, 400), rng.integers(1, 40, 400)), "period": np.tile([1, 2, 1], 999), "one": np.array([7]), "none": np.array([], int)}[kind]
    shard = repair_store.Shard(repair_store.build_shard([5], [ids.astype(np.uint32)], 100, 0))
    assert (shard.document(0) == ids).all()
    for a, b in [(0, 0), (1, len(ids)), (len(ids) // 3, len(ids) // 2)]:
        assert (shard.ids(a, b) == ids[a:b]).all()
    if kind in ("runs", "period"):
        assert len(shard.symbols) < len(ids) / 2


@pytest.mark.parametrize("kind", ["words", "copies", "zeros"])
def test_no_frequent_pair_is_left(kind):
    rng = np.random.default_rng(2)
    text = rng.zipf(1.3, 20_000) % 500
    ids = {"words": text, "copies": np.tile(text[:700], 60), "zeros": np.zeros(40_000, int)}[kind].astype(np.uint32)
    symbols, rules = repair_store.compress(ids, 1000)
    pairs, count = np.unique(np.stack([symbols[:-1], symbols[1:]]), axis=1, return_counts=True)
    assert not len(count) or count.max() < repair_store.LEAST_COUNT
    assert len(symbols) + 2 * len(rules) < {"words": 0.9, "copies": 0.1, "zeros": 0.01}[kind] * len(ids)
    out = symbols.tolist()
    while any(x >= 1000 for x in out):
        out = [y for x in out for y in (rules[x - 1000].tolist() if x >= 1000 else [x])]
    assert out == ids.tolist()


def test_overlapping_pairs_are_chosen_by_rank():
    take = lambda place, rank: repair_store.chosen(np.array(place), np.array(rank)).tolist()
    assert take([0, 1, 5], [1, 2, 1]) == [False, True, True]
    assert take([3, 4, 5, 6], [2, 2, 2, 2]) == [True, False, True, False]
    assert take([3, 4, 5], [2, 2, 3])[2] and not take([3, 4, 5], [2, 2, 3])[1]


def test_chunks_with_one_hash(monkeypatch):
    monkeypatch.setattr(byte_bpe, "mix", lambda x: x & np.uint64(6))
    coder = byte_bpe.ByteBpe(byte_bpe.default_path())
    texts = [t or "" for t in ODD] + ["many words that all have one of four hashes " * 5]
    assert coder.encode(texts) == coder.encode(texts) == [np.array(library_ids(t)[:-1], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_blocks_and_a_full_memory(monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    monkeypatch.setattr(byte_bpe, "MEMORY", 5)
    coder = byte_bpe.ByteBpe(byte_bpe.default_path())
    texts = ["a  b \u00a0 c\u3000 d e\u0085 f \x1c g", " lead", "trail ", "x" * 300, "\ufeff q \u200b r", *[t or "" for t in ODD]]
    for _ in range(2):
        assert coder.encode(texts) == [np.array(library_ids(t)[:-1], "<u4").tobytes() for t in texts]
    assert coder.encode([]) == []


def test_op2_on_documents(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair_store.op2_token_file(spark, SF).collect()}
    at, docs = 0, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library_ids(d.text)
        assert got[d.doc_id] == (at, len(ids), crc(ids))
        at += len(ids)


def test_pieces_as_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    model = piece_bpe.default_path()
    for r in piece_bpe.decode(piece_bpe.encode(odd, model), model).collect():
        want = sp.encode(ODD[r.doc_id] or "")
        assert r.ids == want and r.text == sp.decode(want)


def test_op6_on_documents(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = piece_bpe.op6_sentencepiece(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pieces_of_odd_rows(spark):
    import sentencepiece

    model = piece_bpe.default_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert piece_bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0
    rows = [(None, "no id"), (1, "x" * 20_000), (2, "ab" * 9_000 + " end"), (2, "ab" * 9_000 + " end"), (3, "é" * 3_000)]
    got = piece_bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), model).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), sp.encode(t)) for i, t in rows)


def test_packing_repeats_and_null_ids(spark):
    rows = [(1, "same words"), (1, "same words"), (None, "no id"), (None, "no id"), (None, None), (2, "long " * 3000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), byte_bpe.default_path(), size=64, n_open=2).collect()
    for i in (1, 2, None):
        assert sum(p.length for p in pieces if p.doc_id == i) == sum(len(library_ids(t)) for j, t in rows if j == i)
    for s in {p.sequence_id for p in pieces}:
        mine = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in mine] == list(np.cumsum([0] + [p.length for p in mine])[:-1])


def check_packing(rows, texts, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        pieces = sorted(by_doc.pop(doc), key=lambda r: r.start)
        ids = b"".join(bytes(p.ids) for p in pieces)
        assert ids == np.array(library_ids(text), "<u4").tobytes()
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert {p.doc_tokens for p in pieces} == {len(ids) // 4}
    assert not by_doc
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        total = sum(p.length for p in pieces)
        assert total <= size and (total == size or total & (total - 1) == 0)


@pytest.mark.parametrize("task_ids", [1 << 22, 64])
def test_packing_every_id_once(spark, odd, monkeypatch, task_ids):
    monkeypatch.setattr(packing, "TASK_IDS", task_ids)
    rows = packing.pack(odd.dropDuplicates(["doc_id"]), byte_bpe.default_path(), size=64, n_open=3).collect()
    check_packing(rows, dict(enumerate(ODD)), 64)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), byte_bpe.default_path()).count() == 0


def test_packing_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(packing.pack(docs, byte_bpe.default_path()).collect(), {d.doc_id: d.text for d in docs.collect()}, 1024)
