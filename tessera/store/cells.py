"""Exact search for the most similar vectors, in cells: only cells that can still hold one of the k best are visited.

Vectors are dealt to the nearest of C centres, which are fitted on a bounded sample; every vector is in a cell, with its
distance r from the centre c. By the Cauchy-Schwarz inequality q.v <= q.c + |q| r for a vector v of the cell, so a cell
whose centre and radius keep that below the k-th best score found so far can't matter. A query first visits the cells
that promise most, until they hold k vectors; the k-th score found there is its bar, and it is then compared with every
cell whose promise reaches the bar. Results are those of a comparison with all vectors.

For that, queries are dealt to parts of about PART, one a task, and the cells' vectors stream by every part in packs of
CHUNK at most; BLOCK queries are compared with a pack at once. So no query is sent once for each cell that it visits, and
what a task holds is bounded. Vectors are sent n / PART times.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Vectors of the sample that centres are fitted on, and centres at most.
SAMPLE, CENTRES = 20_000, 1024
#: Vectors of a cell, and queries that visit it, that one task compares at once.
CHUNK, BLOCK = 4096, 1024
#: Scores count as equal if they round to the same nine digits; bounds are taken this much wider.
DIGITS, SLACK = 9, 1e-8
#: Queries that one task holds at most, and at least if there are few, rows that are sent on at once, and queries whose scores a task of bars takes at once.
PART, LEAST, VISITS, SLICE = 16_384, 1024, 4096, 256
#: The id of no vector.
NOBODY = np.iinfo(np.int64).max


def fit_centres(rows: DataFrame, n: int, centres: int, rounds: int = 6) -> np.ndarray:
    """k-means on a sample of SAMPLE vectors, drawn by a hash of their ids: about the square root of n centres."""
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE)
    x = np.array([r.v for r in drawn.select("v").collect()], float)
    if not len(x):
        return np.zeros((1, 1))
    k = int(max(1, min(centres, round(n**0.5), len(x))))
    c = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(rounds):
        of = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        size = np.bincount(of, minlength=k)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


class Part:
    """Queries of one task, and the k best that each has met so far."""

    def __init__(self, number: int, k: int, centres: np.ndarray, radius: np.ndarray, block: int):
        self.number, self.k, self.c, self.radius, self.block = number, k, centres, radius, block
        self.rows, self.q = [], None

    def add(self, query: int, v: np.ndarray, bar: float | None) -> None:
        self.rows.append((query, v.copy(), -np.inf if bar is None else bar))

    def ready(self) -> None:
        n = len(self.rows)
        self.ids, self.q = np.array([r[0] for r in self.rows], np.int64), np.array([r[1] for r in self.rows], float).reshape(n, self.c.shape[1])
        self.bar, self.rows = np.array([r[2] for r in self.rows], float), []
        self.length = np.sqrt((self.q * self.q).sum(1))
        self.best, self.of, self.compared = np.full((n, self.k), -np.inf), np.full((n, self.k), NOBODY), np.zeros(n, np.int64)

    def meet(self, cell: int, ids: np.ndarray, flat: np.ndarray) -> None:
        """ids: in ascending order, so the first of the best scores is the one with the smallest id."""
        if self.q is None:
            self.ready()
        if not len(self.q):
            return
        v = flat.reshape(len(ids), -1)
        promise = self.q @ self.c[cell] + self.length * self.radius[cell]
        near = np.flatnonzero(promise >= self.bar - SLACK)
        for at in range(0, len(near), self.block):
            rows = near[at : at + self.block]
            score = self.q[rows] @ v.T
            self.compared[rows] += len(ids)
            own = np.searchsorted(ids, self.ids[rows])
            same = np.flatnonzero(ids[np.minimum(own, len(ids) - 1)] == self.ids[rows])
            for i in same:  # a row itself, or all rows of its id
                score[i, own[i] : np.searchsorted(ids, self.ids[rows[i]], "right")] = -np.inf
            some = np.flatnonzero((score.max(axis=1) >= self.bar[rows] - SLACK) & np.isfinite(score.max(axis=1)))
            if len(some):
                self.merge(rows[some], score[some], ids)

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        n, shown = np.arange(len(rows)), np.round(score, DIGITS)
        new, who = np.full((len(rows), self.k), -np.inf), np.full((len(rows), self.k), NOBODY)
        for j in range(min(self.k, len(ids))):
            at = np.argmax(shown, axis=1)
            there = np.isfinite(shown[n, at])
            new[there, j], who[there, j] = score[n, at][there], ids[at][there]
            shown[n, at] = -np.inf
        both, whose = np.concatenate([self.best[rows], new], axis=1), np.concatenate([self.of[rows], who], axis=1)
        order = np.lexsort((whose, -np.round(both, DIGITS)), axis=1)[:, : self.k]
        self.best[rows], self.of[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)
        self.bar[rows] = np.maximum(self.bar[rows], np.round(self.best[rows, -1], DIGITS))

    def found(self) -> pa.RecordBatch:
        if self.q is None:
            self.ready()
        row, col = np.nonzero(np.isfinite(self.best))
        query, none = np.concatenate([self.ids[row], self.ids]), np.zeros(len(self.ids), bool)
        is_hit = np.concatenate([np.ones(len(row), bool), none])
        ids, score = np.concatenate([self.of[row, col], np.zeros(len(self.ids), np.int64)]), np.concatenate([self.best[row, col], np.zeros(len(self.ids))])
        compared = np.concatenate([np.zeros(len(row), np.int64), self.compared])
        return pa.record_batch({"query": query, "id": pa.array(ids, mask=~is_hit), "score": pa.array(score, mask=~is_hit), "compared": compared})


class Cells:
    """An index of vectors: (cell, chunk, id, v, r), and (cell, n, radius) of each cell."""

    def __init__(self, rows: DataFrame, centres: np.ndarray, members: DataFrame, chunk: int | None = None, block: int | None = None):
        self.rows, self.centres, self.members = rows, centres, members
        self.chunk, self.block = chunk or CHUNK, block or BLOCK
        found = members.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")).collect()  # a row a cell: CENTRES at most
        self.size, self.radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for r in found:
            self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["radius"]

    @staticmethod
    def build(df: DataFrame, key: str, vector: str, store, centres: int = CENTRES, chunk: int | None = None, block: int | None = None) -> "Cells":
        """store: writes a table and reads it back. Rows without id or vector are left out."""
        rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
        rows = store(rows, "vectors")
        c = fit_centres(rows, rows.count(), centres)

        def deal(batches):
            square = (c * c).sum(1)
            for b in batches:
                if b.num_rows:
                    v = np.stack(b["v"].to_numpy(zero_copy_only=False))
                    cell = np.argmin(square - 2 * v @ c.T, axis=1)
                    r = np.sqrt(((v - c[cell]) ** 2).sum(1))
                    yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "id": b["id"], "v": b["v"], "r": pa.array(r)})

        members = rows.mapInArrow(deal, "cell int, id bigint, v array<double>, r double").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("cell", "id")
        return Cells(rows, c, store(members, "cells"), chunk, block)

    def _first(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, qv, cell): the cells that promise a query most, until they hold k vectors besides the query itself."""
        c, size, radius = self.centres, self.size, self.radius

        def choose(batches):
            there = size > 0
            for whole in batches:
                for at in range(0, whole.num_rows, VISITS):
                    b = whole.slice(at, VISITS)
                    q = np.stack(b["qv"].to_numpy(zero_copy_only=False))
                    promise = np.where(there, q @ c.T + np.sqrt((q * q).sum(1))[:, None] * radius, -np.inf)
                    order = np.argsort(-promise, axis=1, kind="stable")
                    held = np.cumsum(size[order], axis=1) - size[order]
                    row, place = np.nonzero((held < k + 1) & np.isfinite(np.take_along_axis(promise, order, 1)))
                    for i in range(0, len(row), VISITS):
                        picked = b.take(pa.array(row[i : i + VISITS]))
                        cell = pa.array(order[row[i : i + VISITS], place[i : i + VISITS]], pa.int32())
                        yield pa.RecordBatch.from_arrays([picked["query"], picked["qv"], cell], ["query", "qv", "cell"])

        return asked.mapInArrow(choose, "query bigint, qv array<double>, cell int")

    def _bars(self, visits: DataFrame, k: int) -> DataFrame:
        """(query, bar): the k-th best score in the first chunk of the cells that a query visits first; bounds its hits from
        below, so which of the vectors are seen is free."""
        of = visits.groupBy("cell").agg(F.ceil(F.count("*") / self.block).cast("int").alias("blocks"))  # a row a cell
        left = visits.join(F.broadcast(of), "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int"))
        chunks = np.maximum(1, -(-self.size // self.chunk)).tolist()
        cut = F.element_at(F.array(*map(F.lit, chunks)), F.col("cell") + 1)
        right = self.members.where(F.pmod(F.xxhash64("id"), cut) == 0).join(F.broadcast(of), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def compare(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            out = {"query": [], "score": []}
            if len(asked) and len(members):
                ids, own, v = members["id"].to_numpy(), asked["query"].to_numpy(), np.stack(members["v"]).T
                score = np.concatenate([np.stack(asked["qv"][i : i + SLICE]) @ v for i in range(0, len(asked), SLICE)])
                score[ids[None, :] == own[:, None]] = -np.inf
                best = -np.sort(-np.partition(score, max(0, len(ids) - k), axis=1)[:, -k:], axis=1)
                row, col = np.nonzero(np.isfinite(best))
                out = {"query": own[row], "score": best[row, col]}
            return pd.DataFrame(out)

        grouped = left.groupBy("cell", "block").cogroup(right.select("cell", "block", "id", "v").groupBy("cell", "block"))
        found = grouped.applyInPandas(compare, "query bigint, score double")
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"))))
        return ranked.where(F.col("rank") == k).select("query", F.col("score").alias("bar"))

    def _packed(self) -> DataFrame:
        """(cell, n, ids, vs): the members in packs of at most `chunk` vectors of one cell, as bytes."""
        chunk = self.chunk

        def pack(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cell, ids = b["cell"].to_numpy(), b["id"].to_numpy()
                v = np.stack(b["v"].to_numpy(zero_copy_only=False))
                cuts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)).tolist() + [len(cell)]
                for i, j in zip(cuts, cuts[1:]):
                    for at in range(i, j, chunk):
                        to = min(j, at + chunk)
                        order = at + np.argsort(ids[at:to])
                        mine, short = v[order], v[order].astype(np.float32)
                        mine = short if (short == mine).all() else mine  # half as long, if nothing is lost
                        yield pa.record_batch({"cell": pa.array([cell[at]], pa.int32()), "ids": pa.array([ids[order].tobytes()]), "vs": pa.array([mine.tobytes()])})

        kept = self.members.select("cell", "id", "v")
        return kept.mapInArrow(pack, "cell int, ids binary, vs binary")

    def _compared(self, asked: DataFrame, parts: int, packs: DataFrame, k: int) -> DataFrame:
        """(query, id, score, compared) of asked (query, qv, bar, part): of each query its k best, or a few more; compared is
        in one row a query.

        A task holds one part's queries and lets all packs stream by: what it holds is bounded, and a pack is sent once for
        each part, not for each query. Packs of cells that can't reach a query's bar aren't compared with it.
        """
        c, radius, block = self.centres, self.radius, self.block
        of = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        none = lambda t: F.lit(None).cast(t)
        rows = asked.select("part", "query", "qv", "bar", none("int").alias("cell"), none("binary").alias("ids"), none("binary").alias("vs"))
        rows = rows.unionByName(packs.select(of, none("bigint").alias("query"), none("array<double>").alias("qv"), none("double").alias("bar"), "cell", "ids", "vs"))
        rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("cell").asc_nulls_first())

        def scan(batches):
            part = None
            for b in batches:
                cells, of = b["cell"].to_numpy(zero_copy_only=False), b["part"].to_numpy()
                for i in range(b.num_rows):
                    if part is None or part.number != of[i]:
                        if part is not None:
                            yield part.found()
                        part = Part(of[i], k, c, radius, block)
                    if b["query"][i].is_valid:
                        part.add(b["query"][i].as_py(), b["qv"][i].values.to_numpy(), b["bar"][i].as_py())
                    else:
                        ids, flat = np.frombuffer(b["ids"][i].as_buffer(), np.int64), b["vs"][i].as_buffer()
                        kind = np.float32 if flat.size == 4 * len(ids) * c.shape[1] else np.float64
                        part.meet(int(cells[i]), ids, np.frombuffer(flat, kind).astype(np.float64))
            if part is not None:
                yield part.found()

        return rows.mapInArrow(scan, "query bigint, id bigint, score double, compared bigint")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, store) -> tuple[DataFrame, DataFrame]:
        """((query, rank, id, score), (query, compared)): the k best of each query, a row itself left out, ties by id; and
        with how many vectors it was compared. Queries without id or vector have no rows."""
        asked = queries.select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("qv")).where("query is not null and qv is not null and size(qv) > 0")
        asked = store(asked, "asked")
        bars = store(self._bars(self._first(asked, k), k), "bars")
        n = asked.count()
        parts = max(1, -(-n // PART), min(2 * asked.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
        dealt = asked.join(bars, "query", "left").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        found = store(self._compared(dealt, parts, self._packed(), k), "found")
        hits = found.where("id is not null").select("query", "id", "score")
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("score", DIGITS).desc(), "id"))
        hits = hits.withColumn("rank", rank).where(F.col("rank") <= k)
        return hits.select("query", "rank", "id", "score"), found.groupBy("query").agg(F.max("compared").alias("compared"))
