"""Bounded-space online packing of token ids into windows.

Every partition keeps a fixed number of open windows. A document's ids come in pieces of at most one window; a piece
goes into the open window that it leaves least room in. If it fits in none, the fullest window is completed with the
front of the piece and emitted, and the rest goes on; the windows open at the end of a partition are its leftovers.
Leftovers of all partitions are packed again in the same way, in rounds, until one small task holds the last ones; their
ids fill whole windows, and the tail becomes sequences of lengths that are powers of two, which need no padding.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe, default_path
from .common import small_batches, stored, table

SIZE = 1024
OPEN = 16
#: Leftover ids that one task of a merge round takes.
TASK_IDS = 1 << 22
SCHEMA = "doc_id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open boolean"
FIELDS = ("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids", "open")


class Packer:
    """Packs pieces (doc_id, start, doc_tokens, ids); rows gathers what has been emitted."""

    def __init__(self, base: int, size: int, n_open: int):
        self.size, self.n_open, self.next = size, n_open, base
        self.windows: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], still_open: bool = False) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, total, self.next, at, ids.tobytes(), still_open))
            at += len(ids)
        self.next += 1

    def put(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids):
            n = min(len(ids), self.size)
            if n == self.size:
                self.emit([(doc, start, total, ids[:n])])
            else:
                fits = [w for w in self.windows if w[0] + n <= self.size]
                if fits:
                    window = max(fits, key=lambda w: w[0])
                elif len(self.windows) < self.n_open:
                    window = [0, []]
                    self.windows.append(window)
                else:
                    window = max(self.windows, key=lambda w: w[0])
                    n = self.size - window[0]
                window[0] += n
                window[1].append((doc, start, total, ids[:n]))
                if window[0] == self.size:
                    self.windows.remove(window)
                    self.emit(window[1])
            start, ids = start + n, ids[n:]

    def close(self) -> None:
        for _, pieces in self.windows:
            self.emit(pieces, True)
        self.windows = []

    def settle(self) -> None:
        """The last leftovers: full windows, then lengths that are powers of two."""
        rest = [p for _, pieces in self.windows for p in pieces]
        left = sum(len(p[3]) for p in rest)
        self.windows = []
        while left:
            room = min(self.size, 1 << (left.bit_length() - 1)) if left < self.size else self.size
            left -= room
            now = []
            while room:
                doc, start, total, ids = rest[0]
                n = min(room, len(ids))
                now.append((doc, start, total, ids[:n]))
                rest[0] = (doc, start + n, total, ids[n:])
                if n == len(ids):
                    rest.pop(0)
                room -= n
            self.emit(now)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        types = (pa.int64(),) * 5 + (pa.binary(), pa.bool_())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], FIELDS)


def first_id(level: int) -> int:
    """Sequences are numbered by round, partition and order in it."""
    return level << 56 | TaskContext.get().partitionId() << 32


def pack(df: DataFrame, tokenizer: str, size: int = SIZE, n_open: int = OPEN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit).

    size must be a power of two. A null or empty text is the end id alone; a text of any length is cut into pieces.
    Repeated rows and null ids are packed like others. Other columns are ignored; an empty df gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)

    def online(batches):
        coder, packer = byte_bpe(tokenizer), Packer(first_id(0), size, n_open)
        for b in batches:
            for doc, raw in zip(b["id"].to_pylist(), coder.encode(b["text"].to_pylist())):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                packer.put(doc, 0, len(ids), ids)
            yield packer.take()
        packer.close()
        yield packer.take()

    def merging(level: int, last: bool):
        def merge(batches):
            packer = Packer(first_id(level), size, n_open)
            for b in batches:
                for doc, start, total, raw in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                    packer.put(doc, start, total, np.frombuffer(raw, "<u4"))
                yield packer.take()
            packer.settle() if last else packer.close()
            yield packer.take()

        return merge

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = stored(rows.mapInArrow(online, SCHEMA), "packed")
    done, level, most = [packed.where("not open")], 1, None
    while True:
        open_rows = packed.where("open")
        ids = open_rows.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 4
        tasks = min(-(-ids // TASK_IDS), most or 1 << 30)
        most = max(1, tasks // 2)  # every round has at most half the tasks of the one before
        if not tasks:
            break
        dealt = open_rows.repartition(tasks, F.xxhash64("sequence_id")) if tasks > 1 else open_rows.repartition(1)
        packed = stored(dealt.mapInArrow(merging(level, tasks == 1), SCHEMA), "packed")
        done.append(packed.where("not open"))
        if tasks == 1:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("length"), "doc_tokens", "sequence_id", "offset", "ids")


def op7_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"), default_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
