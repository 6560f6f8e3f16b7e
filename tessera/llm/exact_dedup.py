"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts its (digest, best row, count) entries into one run. The runs then meet in rounds, as in a
binomial tree of radix `fan_in`: in round i the `fan_in` nodes whose numbers differ in digit i only exchange
slices, so that each of them merges `fan_in` sorted slices and keeps, of equal digests, the verified best row.
After the last round node k holds the k-th share of the digest space, merged over all partitions. A run's size
never exceeds about the entries of one input partition, whatever the number of copies: copies of one text collapse
to one entry in the first merge they meet in.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, table

#: One entry of a run: digest, code points, id, row number, rows with this digest.
ENTRY = np.dtype([("digest", "S32"), ("length", "<i8"), ("id", "<i8"), ("row", "<i8"), ("count", "<i8")])
NO_ID = np.iinfo(np.int64).max
WHITESPACE = " \t\n\x0b\x0c\r"


def normalised(text):
    """The text without the characters [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sorted_run(entries: np.ndarray) -> np.ndarray:
    """A leaf's run: entries sorted by digest, of equal ones the best with the counts added."""
    if not len(entries):
        return entries
    run = entries[np.lexsort((entries["row"], entries["id"], -entries["length"], entries["digest"]))]
    first = np.flatnonzero(np.r_[True, run["digest"][1:] != run["digest"][:-1]])
    out = run[first].copy()
    out["count"] = np.add.reduceat(run["count"], first)
    return out


def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b's rows stay rather than a's: the longer text's, then the smaller id's, then the earlier row's."""
    shorter, same = a["length"] < b["length"], a["length"] == b["length"]
    return shorter | same & ((a["id"] > b["id"]) | (a["id"] == b["id"]) & (a["row"] > b["row"]))


def merge_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One run of two: b's digests find their places in a; equal ones (all 32 bytes) become the better entry."""
    if len(a) < len(b):
        a, b = b, a
    place = np.searchsorted(a["digest"], b["digest"])
    there = place < len(a)
    there[there] = a["digest"][place[there]] == b["digest"][there]
    at, twin = place[there], b[there]
    out = a.copy()
    out[at] = np.where(better(a[at], twin), twin, a[at])
    out["count"][at] = a["count"][at] + twin["count"]
    return np.insert(out, place[~there], b[~there])


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of several, each with distinct digests: always the two shortest are merged."""
    heap = [(len(r), i, r) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    n = len(runs)
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        run = merge_two(one[2], two[2])
        heapq.heappush(heap, (len(run), n, run))
        n += 1
    return heap[0][2] if heap else np.empty(0, ENTRY)


def owner(run: np.ndarray, nodes: int) -> np.ndarray:
    """The node that ends up with each entry: its digest's share of the digest space."""
    head = run["digest"].astype("S4").view(">u4").astype(np.uint64) if len(run) else np.empty(0, np.uint64)
    return ((head * np.uint64(nodes)) >> np.uint64(32)).astype(np.int64)


def slices(node: int, run: np.ndarray, step: int, fan_in: int, nodes: int):
    """(destination, sorted slice) for the round whose digit has the weight `step`."""
    digit = owner(run, nodes) // step % fan_in
    base = node - node // step % fan_in * step
    for d in np.unique(digit):
        yield base + int(d) * step, run[digit == d]


RUN_SCHEMA = "node bigint, run binary"


def as_batch(pairs) -> pa.Table:
    pairs = list(pairs)
    return pa.table({"node": pa.array([n for n, _ in pairs], pa.int64()), "run": pa.array([r.tobytes() for _, r in pairs], pa.binary())})


def winners(digests: DataFrame, fan_in: int) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of every digest with two rows or more."""
    leaves = max(1, digests.rdd.getNumPartitions())
    rounds = 1
    while fan_in**rounds < leaves:
        rounds += 1
    nodes = fan_in**rounds

    def leaf(batches):
        node, runs = TaskContext.get().partitionId(), []
        for b in batches:
            new = np.empty(b.num_rows, ENTRY)
            new["digest"] = np.array(b["digest"].to_pylist(), "S32")
            new["id"] = b["id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            new["length"], new["row"], new["count"] = b["length"].to_numpy(), b["row"].to_numpy(), 1
            runs.append(sorted_run(new))
        if runs:
            yield from as_batch(slices(node, merge(runs), 1, fan_in, nodes)).to_batches()

    def exchange(step: int):
        def at_node(group: pa.Table) -> pa.Table:
            node = group["node"][0].as_py()
            run = merge([np.frombuffer(x.as_py(), ENTRY) for x in group["run"]])
            return as_batch(slices(node, run, step, fan_in, nodes))

        return at_node

    def last(group: pa.Table) -> pa.Table:
        run = merge([np.frombuffer(x.as_py(), ENTRY) for x in group["run"]])
        run = run[run["count"] > 1]
        ids = run["id"]
        return pa.table({"digest": pa.array([d.ljust(32, b"\0") for d in run["digest"].tolist()], pa.binary()), "keep_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "keep_row": pa.array(run["row"]), "group_size": pa.array(run["count"])})

    runs = digests.select("digest", "length", "id", "row").mapInArrow(leaf, RUN_SCHEMA)
    for i in range(1, rounds):
        runs = runs.groupBy("node").applyInArrow(exchange(fan_in**i), RUN_SCHEMA)
    return runs.groupBy("node").applyInArrow(last, "digest binary, keep_id bigint, keep_row bigint, group_size bigint")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, row_col: str | None = None) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are; the row with most code points stays, then the smallest id.
    A null text counts as empty, so empty and null texts form one group. A null id sorts after all others. Of
    repeated rows (same id and text) exactly one is kept. Other columns of df are ignored, an empty df gives no
    rows. Ids must be integers. If df numbers its rows in row_col, with no number twice, the result has it too.
    """
    small_batches(df.sparkSession)
    digests = stored(
        df.select(
            F.col(id_col).cast("bigint").alias("id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("length"),
            F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"),
            (F.col(row_col).cast("bigint") if row_col else F.monotonically_increasing_id()).alias("row"),
        ),
        "digests",
    )
    best = winners(digests, fan_in)
    # A hot digest has one row on the right and many on the left, which the adaptive skew join splits.
    joined = digests.join(best, "digest", "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
