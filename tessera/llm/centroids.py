"""Centroid clustering of integer vectors: screening in float32, decided exactly.

A vector's components become the integers floor(SCALE * x). In each round every vector goes to its nearest centroid by
squared Euclidean distance (of equally near ones the one with the smaller number), and each centroid that got some
becomes the floored mean of its vectors.

Distances to all centroids come from one float32 matrix product a batch. Each carries an interval that holds the true
value for certain, whatever order the product is summed in: a sum of n products of numbers that are rounded to float32
first is off by no more than g / (1 - g) * |x| * |c| with g = (n + 2) * 2^-24, by the standard bound and Cauchy-Schwarz.
The centroids whose interval reaches down to the lowest upper end are the shortlist; a vector with more than one is
decided by exact integer distances. The distance that is returned is always the exact one.

What travels: K centroids to the tasks, from each task one row of integer sums for each centroid, which Spark adds up,
and K rows of totals to the driver. The table is read once a round.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, small_batches, stored, table

DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Components must stay below this, so that a squared distance fits a 64-bit integer.
LIMIT = 1 << 27
UNIT = 2.0**-24


def kept_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers): the numbers of a batch's rows that are kept, and their components."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
    fine = np.isfinite(values).all(axis=1)
    grown = np.floor(values[fine] * scale)
    if grown.size and np.abs(grown).max() >= LIMIT:
        raise ArithmeticError(f"a component reaches {LIMIT} after scaling: its squared distances don't fit a long")
    return rows[fine], grown.astype(np.int64)


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): certain bounds of every vector's squared distance to every centroid, less the vector's own square."""
    g = (x.shape[1] + 2) * UNIT
    dots = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = np.einsum("ij,ij->i", centroids, centroids).astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))[:, None] * np.sqrt(squares) * (1 + 1e-9)
    score = squares - 2 * dots
    off = 2 * g / (1 - g) * lengths + 2.0**-49 * (squares + 2 * lengths)  # the second part is for float64's own rounding
    return score - off, score + off


def assign(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, vectors that the screening left open) of integer vectors; all exact."""
    low, high = intervals(x, centroids)
    listed = low <= high.min(axis=1, keepdims=True)
    cluster = listed.argmax(axis=1)
    open_ = np.flatnonzero(listed.sum(axis=1) > 1)
    if len(open_):
        row, c = np.nonzero(listed[open_])
        order = np.lexsort((c, exact(x[open_[row]], centroids[c]), row))
        first = order[np.searchsorted(row[order], np.arange(len(open_)))]
        cluster[open_] = c[first]
    return cluster, exact(x, centroids[cluster]), len(open_)


def seeds(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int, k: int) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of `1:<id>`, in that order; null ids come last, and of rows with one id
    the lesser vector first."""
    v = F.col(vector_col)
    fine = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(fine).select(v.alias("v")).orderBy(F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256).asc_nulls_last(), v).limit(k).collect()
    return np.floor(np.array([list(r.v) for r in rows], np.float64).reshape(-1, dims) * scale).astype(np.int64)


def next_centroids(df: DataFrame, vector_col: str, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round over all vectors."""
    k, dims = centroids.shape

    def sums(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            _, x = kept_vectors(b["v"], dims, scale)
            if len(x):
                cluster, _, _ = assign(x, centroids)
                n += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(axis=0)
        at = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64()), "total": pa.array(list(total[at]), pa.list_(pa.int64()))})

    part = df.select(F.col(vector_col).alias("v")).mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    whole = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims)])
    out = centroids.copy()
    for r in whole.collect():  # one row a centroid
        out[r.cluster] = [r[f"t{i}"] // r.n for i in range(dims)]
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Vectors of another length, null ones and those with a null or non-finite component are left out. Rows with a null or
    repeated id, and equal vectors, count each. With fewer than k kept vectors there are as many centroids; an empty
    df gives no rows. Other columns are ignored, whatever their names. A component of LIMIT or more after scaling is an
    error, as its squared distances don't fit a long.
    """
    small_batches(df.sparkSession)
    centroids = seeds(df, id_col, vector_col, dims, scale, k)
    if len(centroids):
        for _ in range(rounds):
            centroids = next_centroids(df, vector_col, centroids, scale)
    out_id = fresh_name(df.sparkSession.range(0).selectExpr("1 AS cluster", "1 AS distance", "1 AS cluster_inertia", "1 AS inertia", "1 AS centroid_sha256"), id_col)

    def place(batches):
        for b in batches:
            rows, x = kept_vectors(b["v"], dims, scale)
            if len(x):
                c, d, _ = assign(x, centroids)
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(rows)), pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["id", "cluster", "distance"])

    kind = df.schema[id_col].dataType.simpleString()
    placed = stored(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(place, f"id {kind}, cluster int, distance bigint"), "placed")
    totals = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, totals[c], sum(totals.values()), digests[c]) for c in totals]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("id").alias(out_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: k rows at most


def op13_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    floored = "(s - (s % n + n) % n) // n"
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {K}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(row(d, c)) AS best FROM (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY r)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list({floored} ORDER BY i) AS x FROM
  (SELECT best[2] AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, {DIMS + 1}) t(i) GROUP BY 1, 2) GROUP BY c) m ON m.c = c.c)"""
            )
    return f"""WITH {', '.join(parts)}
SELECT vec_id, c.c::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY c.c))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} c ON c.c = best[2]"""


OP13_SQL = _sql()
