"""A stored memory index: records with their vector numbers, what its backend needs, and a manifest that is written last.

The backend is what embeds the records: a dense model's vectors, dealt to cells, or TF-IDF postings where there is no
model. An index is read back by the tag in its manifest and searched by it; an index that isn't there is an error.
"""

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import stored
from .cells import Cells
from .embedder import DENSE, SPARSE, Embedder
from .folder import Folder
from .sparse import Sparse

MANIFEST = "index.json"


def _keeper(folder: Folder, schemas: dict):
    """Writes a table of the index to its place, notes its schema (an empty table has no file to tell it), reads it back."""

    def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{folder.path}/{name}")
        schemas[name] = df.schema.jsonValue()
        return _open(folder, name, schemas)

    return keep


def _open(folder: Folder, name: str, schemas: dict) -> DataFrame:
    return folder.spark.read.schema(T.StructType.fromJson(schemas[name])).parquet(f"{folder.path}/{name}")


def _working(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    return stored(df, name)


class MemoryIndex:
    """An index as it was loaded: backend, records (with vec_index), and what the backend searches in."""

    def __init__(self, backend: str, records: DataFrame, search_in: Sparse | Cells, embedder: Embedder | None):
        self.backend, self.records, self._in, self._embedder = backend, records, search_in, embedder

    def search(self, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
        """(key, rank, score, and the record's columns) of the k records most similar to each query text; key: an integer
        of its own for each query. By the dense backend every record can be a hit; by TF-IDF those that share a term."""
        if self.backend == SPARSE:
            hits = self._in.search(queries, key, text, k, _working).withColumnRenamed("id", "vec_index")
        else:
            asked = queries.select((-F.col(key).cast("bigint") - 1).alias("_q"), self._embedder.column(F.col(text)).alias("_v"))  # no query is a record
            found, _ = self._in.search(asked, "_q", "_v", k, stored)
            hits = found.select((-F.col("query") - 1).alias(key), "rank", F.col("id").alias("vec_index"), "score")
        return hits.join(self.records, "vec_index")


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of all parts for one index; each part's `file` gets the part's name as a prefix, which for one may be empty,
    so files of one name stay apart. Records that two parts share are kept twice."""
    named = [p.withColumn("file", F.concat(F.lit(f"{name}_"), F.col("file")) if name else F.col("file")) for name, p in parts.items()]
    return reduce(DataFrame.unionByName, named)


def save_index(records: DataFrame, key: str | list[str], text: str, path: str, embedder: Embedder | None = None) -> None:
    """Stores records, numbered by vec_index in the order of key from 0, and their vectors or postings. A folder that holds
    an index is replaced: its manifest goes first and comes back last, so no reader takes parts of two for one."""
    from ..operators.sequence import in_order, placed

    folder = Folder(records.sparkSession, path)
    if folder.names():
        folder.delete(MANIFEST)
        folder.delete()
    schemas: dict = {}
    keep = _keeper(folder, schemas)
    # Texts are written once: a row's place follows from its part's place among the parts.
    rows = placed(keep(in_order(records, [key] if isinstance(key, str) else key), "records"), "vec_index")
    said = {"backend": SPARSE, "records": rows.count()}
    if embedder is None:
        made = Sparse.build(rows, "vec_index", text, keep)
        said |= {"buckets": made.buckets, "postings": made.size}
    else:
        vectors = keep(rows.select("vec_index", embedder.column(F.col(text)).alias("embedding")), "vectors")
        cells = Cells.build(vectors, "vec_index", "embedding", lambda df, name: keep(df, name) if name == "cells" else stored(df, name))
        keep(folder.spark.createDataFrame([(i, c) for i, c in enumerate(cells.centres.tolist())], "cell int, centre array<double>").coalesce(1), "centres")
        said |= {"backend": embedder.tag, "dims": embedder.dims}
    folder.commit(MANIFEST, json.dumps(said | {"schemas": schemas}))


def load_index(spark: SparkSession, path: str, embedder: Embedder | None = None) -> MemoryIndex:
    """The index at path. A dense one needs the embedder that made it, of the same size, for its queries."""
    from ..operators.sequence import placed

    folder = Folder(spark, path)
    if MANIFEST not in folder.names():
        raise FileNotFoundError(f"no memory index at {path}: save one first")
    said = json.loads(folder.read(MANIFEST))
    schemas = said["schemas"]
    records = placed(_open(folder, "records", schemas), "vec_index")
    if said["backend"] == SPARSE:
        return MemoryIndex(SPARSE, records, Sparse(said["records"], said["buckets"], said["postings"], *[_open(folder, n, schemas) for n in Sparse.NAMES]), None)
    if said["backend"] != DENSE or embedder is None or embedder.dims != said["dims"]:
        raise ValueError(f"the index at {path} was made by {said['backend']} with {said.get('dims')} dimensions, which isn't at hand")
    centres = np.array([r["centre"] for r in _open(folder, "centres", schemas).orderBy("cell").collect()])  # CENTRES rows at most
    return MemoryIndex(DENSE, records, Cells(_open(folder, "vectors", schemas), centres, _open(folder, "cells", schemas)), embedder)
