"""Text embedding that can be exchanged: a dense model from a stored artefact, and TF-IDF where there is none.

The dense model is a signed projection: a text's words and bigrams fall into SLOTS hash slots, each slot has an inverse
document frequency that is learned from a corpus, and adds or subtracts its weight in one of DIMS dimensions; vectors
have unit length. It is trained and stored once; Spark loads it once a Python worker and feeds it batches of texts
(predict_batch_udf). Nothing is ever fetched from elsewhere: a path without a readable artefact means TF-IDF.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import with_bigrams, words
from .folder import Folder
from .terms import slices, terms_of

DIMS, SLOTS = 64, 1 << 16
#: Below this length a vector counts as nought and stays as it is.
GENTLE = 1e-8
#: Backend tags of stored artefacts.
DENSE, SPARSE = "projection", "tfidf"


def slot(term: Column, slots: int = SLOTS) -> Column:
    """The hash slot of a term: its MD5's first eight hex digits, modulo slots."""
    return F.pmod(F.conv(F.substr(F.md5(term.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


class Embedder:
    """A loaded dense model: the weight of each slot (SLOTS numbers)."""

    tag = DENSE

    def __init__(self, idf: np.ndarray, dims: int):
        self.idf, self.dims = idf, dims

    def column(self, text: Column, batch: int = 512) -> Column:
        """The vectors of a text column, as array<float>; a null text has the vector of an empty one, all noughts."""
        idf, dims = self.idf, self.dims

        def load():  # runs once a worker
            import hashlib
            from collections import Counter

            slots, place = len(idf), {}

            def slot_of(term: str) -> int:
                if term not in place:
                    if len(place) > 200_000:
                        place.clear()
                    place[term] = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % slots
                return place[term]

            def predict(texts: np.ndarray) -> np.ndarray:
                out = np.zeros((len(texts), dims))
                for row, joined in zip(out, texts):
                    if joined:
                        found = Counter(map(slot_of, joined.split(" ")))
                        s = np.fromiter(found, np.int64, len(found))
                        weight = np.fromiter(found.values(), float, len(found)) * idf[s]
                        np.add.at(row, s % dims, np.where(s // dims % 2 == 0, weight, -weight))
                length = np.sqrt((out * out).sum(axis=1, keepdims=True))
                return (out / np.where(length < GENTLE, 1.0, length)).astype(np.float32)

            return predict

        run = predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
        return run(F.coalesce(F.array_join(with_bigrams(words(text)), " "), F.lit("")))


def train(docs: DataFrame, text: str, path: str, dims: int = DIMS, slots: int = SLOTS) -> None:
    """Learns slot weights from all texts and stores the artefact: weights (a row a slot), then the manifest. A task sends
    how many of its texts have each slot, not the slots of each text."""
    spark, folder = docs.sparkSession, Folder(docs.sparkSession, path)

    def count(batches):
        found = np.zeros(slots, np.int64)
        for b in batches:
            for _, lists in slices(b):
                row, term = terms_of(lists, True)
                coded = term.dictionary_encode()  # each distinct term is hashed once
                of = np.array([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % slots for x in coded.dictionary.to_pylist()], np.int64)
                both = np.unique(row.astype(np.int64) * slots + of[coded.indices.to_numpy()])
                found += np.bincount(both % slots, minlength=slots)
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(found[at])], ["slot", "n"])

    n = docs.count()
    df = docs.select(words(F.col(text)).alias("ws")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("df"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot")).join(df, "slot", "left")
    every.select("slot", (F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")).coalesce(1).write.parquet(f"{folder.path}/weights")
    folder.commit("embedder.json", json.dumps({"tag": DENSE, "dims": dims, "slots": slots, "documents": n}))


_loaded: dict[str, Embedder | None] = {}


def open_embedder(spark: SparkSession, path: str | None) -> Embedder | None:
    """The model at path, or None, which means TF-IDF: there is none, or it can't be read. What was found is kept for the
    process; forget() drops it."""
    if path not in _loaded:
        _loaded[path] = _load(spark, path) if path else None
    return _loaded[path]


def forget() -> None:
    _loaded.clear()


def _load(spark: SparkSession, path: str) -> Embedder | None:
    folder = Folder(spark, path)
    if "embedder.json" not in folder.names():
        return None
    try:
        said = json.loads(folder.read("embedder.json"))
        if said["tag"] != DENSE:
            return None
        rows = spark.read.schema("slot int, idf double").parquet(f"{folder.path}/weights").collect()  # slots rows
    except Exception as e:  # whatever is wrong with an artefact, retrieval goes on without it
        print(f"embedder at {path} can't be read ({type(e).__name__}); TF-IDF is used")
        return None
    idf = np.zeros(said["slots"])
    for r in rows:
        idf[r.slot] = r.idf
    return Embedder(idf, said["dims"])
