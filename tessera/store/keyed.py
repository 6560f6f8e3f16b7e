"""Tables of rows with a key that are changed in place of being rewritten: upserts and numbered appends.

Rows lie in buckets by a hash of their key, in Parquet folders that are never changed once written. A version is a
manifest that names the folders of each bucket; it is written last, in one step, so readers see the version before or
the one after, and a writer that fails in between leaves the one before. Two writers of one version: the second fails.

An upsert rewrites only the buckets that its keys fall into. An append writes new folders, numbers its rows on from
those that are there, and finds the keys that are there by Bloom filters, one for each folder and bucket: only buckets
whose filter knows one of its keys are read. When buckets have more than BUCKET_ROWS rows on average the table is dealt
to more of them, so what a batch reads doesn't grow with the table.
"""

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import stored
from .folder import Folder

#: Mean rows of a bucket beyond which there are more buckets, and folders of a bucket beyond which it is rewritten.
BUCKET_ROWS, BUCKET_FOLDERS = 100_000, 8
#: Bits of a Bloom filter for each key, and bits that a key sets: one false alarm in about 120 keys.
BITS, HASHES = 10, 7


def _positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The HASHES bits that each 64-bit hash sets in a filter of size bits, a power of two."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(size - 1)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    size = 1 << max(6, (len(hashes) * BITS - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[_positions(hashes, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def known(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; those that were put in always are."""
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[_positions(hashes, len(bits))].all(axis=1)


class KeyedTable:
    """The table at path; create() makes it, all else reads or changes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 16, bucket_rows: int = BUCKET_ROWS) -> "KeyedTable":
        """An empty table. Its columns may not begin with _bucket or _hash; an integer column that append() numbers
        belongs to the schema."""
        table = KeyedTable(spark, path)
        first = {"version": 0, "schema": schema.jsonValue(), "key": key, "buckets": buckets, "bucket_rows": bucket_rows, "rows": 0, "next": 0, "data": {}, "blooms": {}, "batches": {}}
        table.folder.commit("versions/00000000.json", json.dumps(first))
        return table

    def exists(self) -> bool:
        return bool(self._versions())

    def _versions(self) -> list[str]:
        return [n for n in self.folder.names("versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The last version's, or that of a given one."""
        names = self._versions()
        if not names:
            raise FileNotFoundError(f"no table at {self.folder.path}")
        return json.loads(self.folder.read(f"versions/{names[-1] if version is None else f'{version:08d}.json'}"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version), None)

    def _read(self, m: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.folder.path}/{d}/_bucket={b}" for b, dirs in m["data"].items() if buckets is None or int(b) in buckets for d in dirs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _dealt(self, m: dict, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(m["key"]), F.lit(m["buckets"])).cast("int"))

    def _write(self, m: dict, rows: DataFrame) -> tuple[str, dict[int, int], str]:
        """(folder, rows of each bucket, folder of the filters) of new rows."""
        at, blooms = f"data/{uuid.uuid4().hex}", f"blooms/{uuid.uuid4().hex}"
        self._dealt(m, rows).repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.folder.path}/{at}")
        if not self.folder.names(at) or not any(n.startswith("_bucket=") for n in self.folder.names(at)):
            return at, {}, blooms
        kind = T.StructType([f for f in T.StructType.fromJson(m["schema"]) if f.name == m["key"]] + [T.StructField("_bucket", T.IntegerType())])
        hashes = self.spark.read.schema(kind).parquet(f"{self.folder.path}/{at}").select("_bucket", F.xxhash64(F.lit(0), m["key"]).alias("_hash"))
        make = lambda x: pd.DataFrame({"_bucket": x["_bucket"].iloc[:1], "n": [len(x)], "bits": [bloom(x["_hash"].to_numpy())]})
        made = hashes.groupBy("_bucket").applyInPandas(make, "_bucket int, n bigint, bits binary")  # a bucket holds a bounded number of keys
        made.write.partitionBy("_bucket").parquet(f"{self.folder.path}/{blooms}")
        sizes = self.spark.read.schema("n bigint, _bucket int").parquet(f"{self.folder.path}/{blooms}").collect()  # a row a bucket
        return at, {r["_bucket"]: r["n"] for r in sizes}, blooms

    def _commit(self, m: dict) -> int:
        m["version"] += 1
        self.folder.commit(f"versions/{m['version']:08d}.json", json.dumps(m))
        return m["version"]

    def _grown(self, m: dict, more: int) -> dict:
        """m, dealt to more buckets if they would hold too many rows; the folders are written, not committed."""
        buckets = m["buckets"]
        while m["rows"] + more > buckets * m["bucket_rows"]:
            buckets *= 2
        if buckets == m["buckets"]:
            return m
        rows = self._read(m, None)
        m = m | {"buckets": buckets}
        at, sizes, blooms = self._write(m, rows)
        return m | {"data": {str(b): [at] for b in sizes}, "blooms": {str(b): [blooms] for b in sizes}}

    def _touched(self, m: dict, rows: DataFrame) -> list[int]:
        return [r[0] for r in self._dealt(m, rows).select("_bucket").distinct().collect()]  # one number a bucket

    def upsert(self, more: DataFrame, order: str) -> int:
        """Puts the rows of more in, by key: of rows with one key the last by order, those of more being later than those
        that are there. Null is a key like others. Returns the new version; without rows nothing changes."""
        m = self.manifest()
        more = stored(more.select(*T.StructType.fromJson(m["schema"]).names), "upsert")
        count = more.count()
        if not count:
            return m["version"]
        m = self._grown(m, count)
        touched = self._touched(m, more)
        both = self._read(m, touched).withColumn("_n", F.lit(0)).unionByName(more.withColumn("_n", F.lit(1)))
        last = F.max_by(F.struct(*more.columns), F.struct("_n", order))
        return self._replaced(m, both.groupBy(m["key"]).agg(last.alias("_r")).select("_r.*"), touched)

    def _replaced(self, m: dict, rows: DataFrame, touched: list[int]) -> int:
        before = self._read(m, touched).count()
        at, sizes, blooms = self._write(m, rows)
        for b in map(str, touched):
            m["data"][b], m["blooms"][b] = [at], [blooms]
        m["rows"] += sum(sizes.values()) - before
        return self._commit(m)

    def _maybe(self, m: dict, keys: DataFrame, touched: list[int]) -> list[int]:
        """The buckets that may hold one of keys, by the filters of the touched ones."""
        paths = [f"{self.folder.path}/{d}/_bucket={b}" for b in map(str, touched) for d in m["blooms"].get(b, [])]
        if not paths:
            return []
        of = F.regexp_extract(F.col("_metadata.file_path"), r"_bucket=(\d+)", 1).cast("int")
        filters = self.spark.read.schema("n bigint, bits binary").parquet(*paths).select("bits", of.alias("_bucket"))
        hashes = self._dealt(m, keys).select("_bucket", F.xxhash64(F.lit(0), m["key"]).alias("_hash"))

        def ask(key, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            h = asked["_hash"].to_numpy()
            hit = len(h) and any(known(f, h).any() for f in filters["bits"])
            return pd.DataFrame({"_bucket": [key[0]] if hit else []}, dtype="int32")

        found = hashes.groupBy("_bucket").cogroup(filters.groupBy("_bucket")).applyInPandas(ask, "_bucket int")
        return [r[0] for r in found.collect()]

    def append(self, rows: DataFrame, order: str, number: str | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Adds the rows whose key the table lacks, of those with one key the first by order, and returns what it did.

        number: the column that numbers rows, on from 0, in the order of order. batch: (stream, number); a batch that was
        committed before changes nothing, so a stream may send it again.
        """
        from ..operators.memory import keep_first
        from ..operators.sequence import global_index

        m = self.manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return {"version": m["version"], "added": 0, "asked": 0, "read": 0, "again": True}
        own = [c for c in T.StructType.fromJson(m["schema"]).names if c != number]
        rows = stored(keep_first(rows.select(*own), [m["key"]], [order]), "append")
        m = self._grown(m, rows.count())
        touched = self._touched(m, rows)
        maybe = self._maybe(m, rows.select(m["key"]), touched)
        there = self._read(m, maybe).select(F.col(m["key"]).alias("_key"))
        fresh = rows.join(there, F.col(m["key"]).eqNullSafe(F.col("_key")), "left_anti")
        if number:
            fresh = global_index(fresh, order, number).withColumn(number, F.col(number) + m["next"])
        at, sizes, blooms = self._write(m, fresh.select(*T.StructType.fromJson(m["schema"]).names))
        for b in map(str, sizes):
            m["data"].setdefault(b, []).append(at)
            m["blooms"].setdefault(b, []).append(blooms)
        added = sum(sizes.values())
        m["rows"], m["next"] = m["rows"] + added, m["next"] + added
        if batch:
            m["batches"][batch[0]] = batch[1]
        version = self._commit(m)
        full = [int(b) for b, dirs in m["data"].items() if len(dirs) > BUCKET_FOLDERS]
        if full:
            version = self._replaced(m, self._read(m, full), full)
        return {"version": version, "added": added, "asked": len(touched), "read": len(maybe), "again": False}

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last versions, and folders that none of those names; returns how many folders went. Not for
        use beside writers, whose folders no version names yet."""
        names = self._versions()
        for n in names[:-keep]:
            self.folder.delete(f"versions/{n}")
        left = {d for n in names[-keep:] for k in ("data", "blooms") for dirs in json.loads(self.folder.read(f"versions/{n}"))[k].values() for d in dirs}
        gone = [f"{k}/{d}" for k in ("data", "blooms") for d in self.folder.names(k) if f"{k}/{d}" not in left]
        for d in gone:
            self.folder.delete(d)
        return len(gone)
