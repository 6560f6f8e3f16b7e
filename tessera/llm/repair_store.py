"""Token ids on disk as Re-Pair grammars.

A shard holds whole documents in ascending id order. Its id sequence is compressed by repeatedly replacing frequent
pairs of adjacent symbols by new nonterminals, until no pair occurs LEAST_COUNT times. A round replaces all pairs that
do, each where it overlaps none that is more frequent; after the first, only pairs with a new symbol, and occurrences
that gave way, can be frequent, so only they are counted, and exactly. The shard keeps the rules, the length that each rule expands to, the remaining symbols, and
how many ids precede every BLOCK-th symbol, so that any range of ids is decoded without what lies before it.

Shard layout (little-endian): magic, seven unsigned 64-bit counts (documents, those without an id, which come last, ids,
symbols, rules, first nonterminal, ids before this shard in its part), then document ids i64, starts u64 (one more than
documents), rules u32 pairs, expansion lengths u32, block table u64, symbols u16 or u32 (u16 if all nonterminals fit).
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .byte_bpe import byte_bpe, default_path
from .common import shared_dir, small_batches, table

MAGIC = b"RPT2"
BLOCK = 256
SHARD_IDS = 1 << 20
#: Pairs that occur less often stay: a rule takes eight bytes and more.
LEAST_COUNT = 8


def chosen(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of occurrences (place in ascending order, rank of their pair, 1 or more), which are replaced: those that outrank
    the ones they overlap with, and of a run of one pair that overlaps itself every second from the left."""
    touching = place[1:] == place[:-1] + 1
    left, right = np.r_[0, np.where(touching, rank[:-1], 0)], np.r_[np.where(touching, rank[1:], 0), 0]
    take = (rank > left) & (rank > right)
    same = np.flatnonzero((rank == left) | (rank == right))
    if len(same):
        p, r = place[same], rank[same]
        begins = np.r_[True, (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1])]
        first = np.maximum.accumulate(np.where(begins, np.arange(len(p)), 0))
        take[same] = ((np.arange(len(p)) - first) % 2 == 0) & (left[same] <= r) & (right[same] <= r)
    return take


def occurrences(pair: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in pair of those that are wanted, which one each is); wanted is sorted. By a table of hashed slots, and
    by search where two of wanted share one."""
    bits = min(20, max(8, (32 * len(wanted)).bit_length()))
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    table = np.full(1 << bits, -1, np.int32)
    table[slot(wanted)] = np.arange(len(wanted), dtype=np.int32)
    k = table[slot(pair)]
    place = np.flatnonzero(k >= 0)
    k, found = k[place], pair[place]
    other = np.flatnonzero(wanted[k] != found)
    k[other] = np.minimum(np.searchsorted(wanted, found[other]), len(wanted) - 1)
    right = np.ones(len(k), bool)
    right[other] = wanted[k[other]] == found[other]
    return place[right], k[right]


def compress(ids: np.ndarray, first: int, least: int = LEAST_COUNT):
    """(symbols, rules): rules[k] is the pair that nonterminal first + k stands for. No pair of symbols is left that
    occurs least times, counting overlaps."""
    s, rules, n_rules = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)], 0
    place = np.arange(max(0, len(s) - 1))  # of pairs that may be frequent
    while len(place):
        pair = (s[place].astype(np.uint64) << np.uint64(32)) | s[place + 1]
        ordered = np.sort(pair)
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[edge, len(ordered)])
        pick = count >= least
        if not pick.any():
            break
        wanted, often = ordered[edge[pick]], count[pick]
        near, k = occurrences(pair, wanted)
        place = place[near]
        rank = np.empty(len(wanted), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(1, len(wanted) + 1)
        take = chosen(place, rank[k])
        at, lost = place[take], place[~take]
        used = np.bincount(k[take], minlength=len(wanted)) > 0
        name = np.cumsum(used) - 1 + first + n_rules
        rules.append(np.stack([wanted[used] >> np.uint64(32), wanted[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(rules[-1])
        s[at] = name[k[take]]
        stays = np.ones(len(s), bool)
        stays[at + 1] = False
        s = s[stays]
        here, lost = at - np.arange(len(at)), lost[stays[lost]]
        again = np.zeros(len(s) + 1, bool)
        again[here] = again[here - 1] = True  # before the first lies the spare last one
        again[lost - np.searchsorted(at, lost)] = True
        again[len(s) - 1 :] = False  # no pair begins at the last symbol
        place = np.flatnonzero(again)
    return s, np.concatenate(rules)


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    out = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.uint32)


class Shard:
    """Reads one shard; ids(a, b) decodes any range of its ids, document(i) one document."""

    def __init__(self, payload: bytes):
        assert payload[:4] == MAGIC
        docs, self.n_null, self.n_ids, n_symbols, n_rules, self.first, self.before = struct.unpack_from("<7Q", payload, 4)
        at = 4 + 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.starts = take("<i8", docs), take("<u8", docs + 1).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules)
        self.blocks = take("<u8", -(-n_symbols // BLOCK)).astype(np.int64)
        self.symbols = take("<u2" if self.first + n_rules <= 1 << 16 else "<u4", n_symbols)
        self._flat = self._begin = None

    def _expansions(self):
        """All rules' expansions in one array, and where each begins."""
        if self._flat is None:
            self._begin = np.r_[0, np.cumsum(self.lengths, dtype=np.int64)]
            flat, begin, first = np.empty(int(self._begin[-1]), np.uint32), self._begin.tolist(), self.first
            for k, pair in enumerate(self.rules.tolist()):
                at = begin[k]
                for x in pair:
                    if x < first:
                        flat[at] = x
                        at += 1
                    else:
                        n = begin[x - first + 1] - begin[x - first]
                        flat[at : at + n] = flat[begin[x - first] : begin[x - first] + n]
                        at += n
            self._flat = flat
        return self._flat, self._begin

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        s = symbols.astype(np.int64)
        rule = np.maximum(s - self.first, 0)
        size = np.ones(len(s), np.int64)
        inner = s >= self.first
        size[inner] = self.lengths[rule[inner]]
        end = np.cumsum(size)
        within = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size)
        out = np.repeat(s, size)
        deep = np.repeat(inner, size)
        out[deep] = flat[np.repeat(begin[rule], size)[deep] + within[deep]]
        return out.astype(np.uint32)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.empty(0, np.uint32)
        lo = int(np.searchsorted(self.blocks, a, "right")) - 1
        hi = int(np.searchsorted(self.blocks, b, "left"))
        skipped = int(self.blocks[lo])
        return self._expand(self.symbols[lo * BLOCK : hi * BLOCK])[a - skipped : b - skipped]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def build_shard(doc_ids: list[int | None], ids: list[np.ndarray], first: int, before: int) -> bytes:
    starts = np.r_[0, np.cumsum([len(x) for x in ids])].astype("<u8")
    symbols, rules = compress(np.concatenate(ids) if ids else np.empty(0, np.uint32), first)
    lengths = lengths_of(rules, first)
    size = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    size[inner] = lengths[symbols[inner] - first]
    blocks = (np.cumsum(size) - size)[::BLOCK]
    known = [i for i in doc_ids if i is not None]  # the others come after them
    doc_ids = [*known, *[0] * (len(doc_ids) - len(known))]
    head = MAGIC + struct.pack("<7Q", len(doc_ids), len(doc_ids) - len(known), int(starts[-1]), len(symbols), len(rules), first, before)
    arrays = np.array(doc_ids, "<i8"), starts, rules.astype("<u4"), lengths.astype("<u4"), blocks.astype("<u8"), symbols.astype("<u2" if first + len(rules) <= 1 << 16 else "<u4")
    return head + b"".join(x.tobytes() for x in arrays)


def write_ids(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encodes every text, appends end_id and writes shards under path, in ascending id order: part, shard, counts and
    payload in Parquet rows, so that any store that Spark writes to will do.

    A null or empty text is the end id alone. Repeated ids keep a document each, next to one another. Rows with a null
    id come after all others. Other columns are ignored; an empty df writes no shard. Ids must be
    integers. A document longer than shard_ids gets a shard to itself.
    """
    small_batches(df.sparkSession)

    def shards(batches):
        coder = byte_bpe(tokenizer)
        first = coder.tokenizer.get_vocab_size()
        part, shard, before = None, 0, 0
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal shard, before, doc_ids, ids, held
            payload = build_shard(doc_ids, ids, first, before)
            row = pa.record_batch({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            shard, before, doc_ids, ids, held = shard + 1, before + held, [], [], 0
            return row

        for b in batches:
            part = b["part"][0].as_py() if b.num_rows and part is None else part
            for i, raw in zip(b["id"].to_pylist(), coder.encode(b["text"].to_pylist())):
                doc = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                if doc_ids and held + len(doc) > shard_ids:
                    yield flush()
                doc_ids.append(i)
                ids.append(doc)
                held += len(doc)
        if doc_ids:
            yield flush()

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged.mapInArrow(shards, "part int, shard int, n_docs bigint, n_ids bigint, payload binary").write.option("compression", "zstd").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document: ids as little-endian unsigned 32-bit integers, start over all documents."""
    small_batches(spark)

    def decode(batches):
        for b in batches:
            for part, payload in zip(b["part"].to_pylist(), b["payload"]):
                s = Shard(payload.as_py())
                for lo in range(0, len(s.doc_ids), 256):  # a block of documents at a time
                    hi = min(lo + 256, len(s.doc_ids))
                    ids = s.ids(int(s.starts[lo]), int(s.starts[hi])).astype("<u4")
                    cut = s.starts[lo : hi + 1] - s.starts[lo]
                    yield pa.record_batch({
                        "part": pa.array([part] * (hi - lo), pa.int32()),
                        "doc_id": pa.array(s.doc_ids[lo:hi], mask=np.arange(lo, hi) >= len(s.doc_ids) - s.n_null),
                        "at": pa.array(s.starts[lo:hi] + s.before),
                        "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    })

    shards = spark.read.schema("part int, shard int, n_docs bigint, n_ids bigint, payload binary").parquet(path)
    # One row per part: as many as the write had partitions, whatever the data.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    docs = shards.select("part", "payload").mapInArrow(decode, "part int, doc_id bigint, at bigint, ids binary")
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "ids")


def op2_token_file(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/tessera/token-shards-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, default_path())
    return read_ids(spark, path).select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
