"""Benchmark decontamination by Wu-Manber search for all windows of a set of test items at once.

Texts are lower-cased (A to Z) and written as their words with one space before, between and after them, in UTF-8; so
is each window of WINDOW consecutive words of an item, and a window occurs in a text exactly where its bytes do.

Windows are searched in classes by length, each with tables of its own over the first m bytes of its windows, m being the
least length of the class. For every position of a text the block of bytes that ends there is looked up in a shift
table: unless it is the last block of some window's first m bytes, the table tells how many positions can be passed
over. Where the shift is nought, the block's hash bucket lists the windows that may stand there; these are compared by
their first eight bytes and then byte for byte. The scan runs over slices of a batch of texts side by side.

Windows reach the tasks in shards of SHARD_BYTES, however large the benchmark is: documents are scanned for one shard
after another, and what was found so far is stored with them. Documents are never shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored, table

WINDOW = 10
#: Bytes of windows that one scan searches for; what is broadcast is a small multiple of it.
SHARD_BYTES = 16 << 20
#: Bytes of a text that one lane of the scan goes through.
LANE = 512
_WORD = [chr(c).isdigit() or chr(c).islower() if c < 128 else True for c in range(256)]
#: Bytes of words as they are, A to Z in lower case, all others as spaces.
FOLD = bytes(c if _WORD[c] else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def fold(text: bytes | None) -> list[bytes]:
    """The words of a text."""
    return text.translate(FOLD).split() if text else []


def _eights(buffer: bytes) -> np.ndarray:
    """The eight bytes from each position on as one number, the first byte lowest; buffer ends with eight spare bytes."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


def _mask(length):
    """Keeps the lowest length bytes (8 at most) of a number."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(length, 8).astype(np.uint64))


class Tables:
    """Shift and bucket tables of the windows whose length has one number of bits."""

    def __init__(self, number: np.ndarray, windows: list[bytes]):
        """number: of each window, as it is told where it occurs."""
        self.number = number
        self.length = np.array([len(w) for w in windows], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = b"".join(windows) + b"\0" * 8
        self.m = int(self.length.min())
        self.block = min(8, self.m)
        spots = self.m - self.block + 1
        self.bits = min(24, max(12, int(len(windows) * spots).bit_length() + 2))
        self.shift = np.full(1 << self.bits, spots, np.uint8 if spots < 256 else np.int64)
        eights = _eights(self.flat)
        for q in range(spots):  # the block that starts at q leaves spots - 1 - q more bytes of the first m
            np.minimum.at(self.shift, self.hashed(eights[self.start + q]), spots - 1 - q)
        last = self.hashed(eights[self.start + spots - 1])
        self.bucket = np.argsort(last, kind="stable")
        self.begin = np.searchsorted(last[self.bucket], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.first = eights[self.start] & _mask(self.length)

    def hashed(self, eight: np.ndarray) -> np.ndarray:
        return ((eight & _mask(np.int64(self.block))) * _GOLD) >> np.uint64(64 - self.bits)

    def candidates(self, eights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the n bytes' positions whose shift is nought."""
        end = np.arange(self.m - 1, n, LANE)
        stop = np.minimum(end + LANE, n)
        at, found = end - (self.block - 1), []
        stop = stop - (self.block - 1)
        while len(at):
            h = self.hashed(eights[at])
            step = self.shift[h].astype(np.int64)
            hit = step == 0
            if hit.any():
                found.append((at[hit], h[hit]))
                step += hit
            at = at + step
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate([x for x, _ in found]) - (self.m - self.block), np.concatenate([x for _, x in found])

    def search(self, eights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence in the buffer of n bytes."""
        at, h = self.candidates(eights, n)
        times = self.begin[h.astype(np.int64) + 1] - self.begin[h.astype(np.int64)]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at, w = np.repeat(at, times), self.bucket[np.repeat(self.begin[h.astype(np.int64)], times) + place]
        same = (eights[at] & _mask(self.length[w])) == self.first[w]
        at, w = at[same], w[same]
        own, done, offset = _eights(self.flat), [(at[:0], w[:0])], 8
        while len(at):
            over = self.length[w] <= offset
            done.append((at[over], w[over]))
            at, w = at[~over], w[~over]
            o = np.minimum(offset, self.length[w] - 8)
            same = (at + o < len(eights)) & (eights[np.minimum(at + o, len(eights) - 1)] == own[self.start[w] + o])
            at, w, offset = at[same], w[same], offset + 8
        return np.concatenate([x for x, _ in done]), self.number[np.concatenate([x for _, x in done])]


class Shard:
    """Windows of items with their tables; window i has words[i] words and belongs to the items of owners[i]."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        owners: dict[bytes, list[str]] = {}
        for window, item in pairs:
            owners.setdefault(window, []).append(item)
        windows = list(owners)
        self.owners = [owners[w] for w in windows]
        self.words = np.array([w.count(b" ") - 1 for w in windows], np.int64)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            classes.setdefault(len(w).bit_length(), []).append(i)
        self.tables = [Tables(np.array(at), [windows[i] for i in at]) for at in classes.values()]

    def search(self, texts: list[list[bytes]], before: list[list[int]]) -> tuple[np.ndarray, list[set[str]], list[list[int]]]:
        """(words hit, items, covered) of each text, given as its words; covered: begins and ends of the stretches of words
        that are hit, those of before included."""
        buffer = b"".join(b" " + b" ".join(w) + b" \0" if w else b"" for w in texts)
        n, eights = len(buffer), _eights(buffer + b"\0" * 8)
        counts = np.array([len(w) for w in texts], np.int64)
        slots = counts + (counts > 0)  # the spaces of each text: one before each word, and one at the end
        first = np.cumsum(slots) - slots
        spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        found = [t.search(eights, n) for t in self.tables]
        at = np.concatenate([np.empty(0, np.int64), *[x for x, _ in found]])
        window = np.concatenate([np.empty(0, np.int64), *[x for _, x in found]])
        slot = np.searchsorted(spaces, at)
        change = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(change, slot, 1)
        np.add.at(change, slot + self.words[window], -1)
        for f, stretches in zip(first, before):
            for b, e in zip(stretches[::2], stretches[1::2]):
                change[f + b] += 1
                change[f + e] -= 1
        hit = np.cumsum(change) > 0
        so_far = np.concatenate([[0], np.cumsum(hit)])
        n_hit = so_far[first + slots] - so_far[first]
        items: list[set[str]] = [set() for _ in texts]
        text = np.searchsorted(first + slots, slot, side="right")
        for t, w in {*zip(text.tolist(), window.tolist())}:
            items[t].update(self.owners[w])
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0))
        of = np.searchsorted(first + slots, edge, side="right")
        covered: list[list[int]] = [[] for _ in texts]
        for t, e in zip(of.tolist(), edge.tolist()):
            covered[t].append(e - int(first[t]))
        return n_hit, items, covered


def windows_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(window, item): the distinct windows of each item; an item with fewer words than a window is one."""

    def cut(batches):
        for b in batches:
            for item, text in zip(b["item"].to_pylist(), b["text"].to_pylist()):
                w = fold(text)
                for lo in range(0, max(1, len(w) - WINDOW + 1), 10_000) if w else ():
                    out = [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(lo, min(lo + 10_000, max(1, len(w) - WINDOW + 1)))]
                    yield pa.record_batch({"window": pa.array(out, pa.binary()), "item": pa.array([item] * len(out), pa.string())})

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "window binary, item string").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    A word is hit if it lies in an occurrence of a window of the benchmark; n_items counts the items that have one, and
    items_sha256 is that of their ids, sorted as strings and joined by commas. Null and empty texts have no words; an
    item without words has no window. Rows with a null or repeated doc_id count each; items with one id are one item, and
    so are those with a null id, which is written as nothing. Other columns are ignored, whatever their names. An
    empty docs gives no rows, an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = stored(windows_of(benchmark, item_col, item_text_col), "windows")
    size = windows.agg(F.sum(F.length("window") + 32)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    number = F.pmod(F.xxhash64("window", "item"), F.lit(shards))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.array().cast("array<string>").alias("items"), F.array().cast("array<int>").alias("covered"))
    kind = docs.schema[id_col].dataType.simpleString()
    for i in range(shards):
        pairs = [(bytes(r.window), r.item) for r in windows.where(number == i).collect()]  # one shard: about shard_bytes
        last, shard = i == shards - 1, spark.sparkContext.broadcast(Shard(pairs))

        def scan(batches, shard=shard, last=last):
            for b in batches:
                texts = [fold(t) for t in b["text"].to_pylist()]
                n_hit, items, covered = shard.value.search(texts, b["covered"].to_pylist())
                items = [sorted(new.union(old)) for new, old in zip(items, b["items"].to_pylist())]
                if last:
                    out = [b["id"], pa.array([len(w) for w in texts], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(out, ["id", "n_words", "n_hit", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([b["id"], b["text"], pa.array(items, pa.list_(pa.string())), pa.array(covered, pa.list_(pa.int32()))], ["id", "text", "items", "covered"])

        if last:
            out = rows.mapInArrow(scan, f"id {kind}, n_words bigint, n_hit bigint, items array<string>")
        else:
            before, rows = rows, stored(rows.mapInArrow(scan, f"id {kind}, text binary, items array<string>, covered array<int>"), "scanned")
            if i:
                dropped(before)
            shard.unpersist()
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s, least(len(w), {WINDOW}) AS k FROM (SELECT *, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM b WHERE len(w) > 0)),
hit AS (SELECT r, i, k, item FROM (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM
  (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)) JOIN p USING (s, k)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
