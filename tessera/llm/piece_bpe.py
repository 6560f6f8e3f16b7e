"""Encoding and decoding with a sentencepiece BPE model by a table of last tokens.

A BPE encoding is determined from its end: for every prefix of a text there is exactly one token that ends the
prefix's encoding. An automaton over the vocabulary finds the tokens that end at a position; of them the right one is
the token whose predecessor, the last token of the shorter prefix, can stand before it, that is, if encoding the two
tokens' text gives the two tokens. The ids are then read off the table backwards.

In a model whose pieces hold the space mark at their front only, no token crosses a space mark that follows another
character, so texts are encoded chunk by chunk, and a chunk that was seen before is looked up.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
#: Chunks, and token pairs, remembered by one Python worker.
MEMORY = 400_000
PAIRS = 1 << 18
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
_loaded: dict[str, "PieceBpe"] = {}


class Chunks(dict):
    """Ids, as little-endian 32-bit integers, of chunks seen before; bytes, unlike lists, cost the collector nothing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = np.array(self.make(chunk), "<i4").tobytes()
        return ids


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == 1}
        self.id_of = {p: i for p, (_, i) in self.score.items()}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unknown_text = model.trainer_spec.unk_surface
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces that go on after a space mark are not supported")
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1 and self.merged(p) == [p]:  # a piece that its own text doesn't encode to is never used
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.compatible = lru_cache(PAIRS)(lambda a, b: self.merged(a + b) == [a, b])
        self.chunks = Chunks(self.encode_chunk)
        texts = [b"" if i in self.control else (self.unknown_text if i == self.unknown else p.replace(MARK, " ")).encode() for i, p in enumerate(self.pieces)]
        for i, byte in self.id_byte.items():
            texts[i] = bytes([byte])
        self.raw_text = texts.__getitem__

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: merge the pair with the best score, leftmost first. For short texts."""
        s = list(text)
        while True:
            best = min(((self.score[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in self.score), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    def last_tokens(self, chunk: str) -> list[str]:
        """Of every prefix of chunk: the last token of its encoding."""
        last, done = list(chunk), -1
        for end, piece in self.automaton.iter(chunk):  # in order of their ends, the longest first
            if end != done:
                begin = end + 1 - len(piece)
                if not begin or self.compatible(last[begin - 1], piece):
                    last[end] = piece
                    done = end
        return last

    def encode_chunk(self, chunk: str) -> list[int]:
        last, at, out = self.last_tokens(chunk), len(chunk), []
        while at:
            token = last[at - 1]
            at -= len(token)
            i = self.id_of.get(token)
            if i is None:
                out += [self.byte_id[b] for b in reversed(token.encode())]
            else:
                out.append(i)
        out.reverse()
        return out

    def encode_raw(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.chunks) > MEMORY:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(MARK * self.dummy_prefix + text.replace(" ", MARK))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library does: bytes in a row form characters, each byte of no character becomes U+FFFD."""
        # Pieces are whole characters, so if all bytes together form characters, so does each run of byte tokens.
        if not ids or ids[0] in self.control:
            return self.decode_broken(ids)
        try:
            text = b"".join(map(self.raw_text, ids)).decode()
        except UnicodeDecodeError:
            return self.decode_broken(ids)
        spaced = self.dummy_prefix and ids[0] != self.unknown and ids[0] not in self.id_byte and text[:1] == " "
        return text[1:] if spaced else text

    def decode_broken(self, ids: list[int]) -> str:
        """For ids that may hold bytes of no character, or control tokens in front."""
        pieces, out, pending = self.pieces, [], bytearray()
        first = True
        for i in ids:
            b = self.id_byte.get(i)
            if b is not None:
                pending.append(b)
                first = False
                continue
            if pending:
                out.append(characters(bytes(pending)))
                pending.clear()
            if i in self.control:
                continue
            piece = self.unknown_text if i == self.unknown else pieces[i].replace(MARK, " ")
            if first and self.dummy_prefix and piece[:1] == " " and i != self.unknown:
                piece = piece[1:]
            first = False
            out.append(piece)
        if pending:
            out.append(characters(bytes(pending)))
        return "".join(out)


def characters(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def piece_bpe(path: str) -> PieceBpe:
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, without begin and end ids. A null or empty text has no ids; repeated rows and null
    ids are encoded like others; other columns are ignored; an empty df gives no rows."""
    small_batches(df.sparkSession)

    def run(batches):
        coder = piece_bpe(model)
        for b in batches:
            ids = [coder.encode_raw(t.as_py()) for t in b["text"]]
            ends = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<i4")
            yield pa.record_batch({"doc_id": b["id"], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(df: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids); null ids count as none."""
    small_batches(df.sparkSession)

    def run(batches):
        coder = piece_bpe(model)
        for b in batches:
            yield pa.record_batch({"doc_id": b["doc_id"], "ids": b["ids"], "text": pa.array([coder.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in b["ids"]], pa.string())})

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def op6_sentencepiece(spark, sf_dir):
    model = default_path()
    both = decode(encode(table(spark, sf_dir, "documents"), model), model)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
