"""An unbounded source of texts: a folder to which Parquet files are added, each row with its place of arrival.

Files count as arrived in the order of their names. A row's place is its number over all files, from 0, so shards by
place are the same however the stream is cut into batches or restarted; only files' footers are read to know places.
An offset is the number of files and rows that were passed. A batch is all that has arrived since; each of its row groups
is a partition, read in parallel, and nothing is copied or downloaded beforehand. The folder must be one that PyArrow reads: local, HDFS or an object
store, by its URI.
"""

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "sharded_texts"


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    place: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.store, self.path = fs.FileSystem.from_uri(options["path"])
        self.shards = int(options.get("shards", 1))
        self.only = int(options.get("shard", -1))
        self.sizes: dict[str, list[int]] = {}

    def _files(self) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))

    def _groups(self, path: str) -> list[int]:
        if path not in self.sizes:
            with self.store.open_input_file(path) as file:
                m = pq.ParquetFile(file).metadata
                self.sizes[path] = [m.row_group(i).num_rows for i in range(m.num_row_groups)]
        return self.sizes[path]

    def initialOffset(self) -> dict:
        return {"files": 0, "rows": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"files": len(files), "rows": sum(sum(self._groups(f)) for f in files)}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        out, place = [], start["rows"]
        for f in self._files()[start["files"] : end["files"]]:
            for g, rows in enumerate(self._groups(f)):
                out.append(RowGroup(f, g, place))
                place += rows
        return out

    def read(self, part: RowGroup):
        with self.store.open_input_file(part.path) as file:
            parquet = pq.ParquetFile(file)
            own = [c for c in ("text", "content") if c in parquet.schema_arrow.names]
            at = part.place
            for b in parquet.iter_batches(batch_size=2000, row_groups=[part.group], columns=own):
                place = pa.array(range(at, at + b.num_rows), pa.int64())
                at += b.num_rows
                text = pa.nulls(b.num_rows, pa.string())
                for c in own:  # the first that isn't empty
                    value = b[c].cast(pa.string())
                    text = pc.coalesce(text, pc.if_else(pc.equal(value, ""), pa.scalar(None, pa.string()), value))
                shard = pa.array([p % self.shards for p in place.to_pylist()], pa.int32())
                keep = pc.is_valid(text)
                if self.only >= 0:
                    keep = pc.and_(keep, pc.equal(shard, self.only))
                yield pa.RecordBatch.from_arrays([place, shard, text], ["place", "shard", "text"]).filter(keep)

    def commit(self, end: dict) -> None:
        pass


class ShardedTexts(DataSource):
    """Options: path (a URI), shards, and shard, to have that one only."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "place bigint, shard int, text string"

    def streamReader(self, schema) -> Reader:
        return Reader(self.options)


def texts(spark: SparkSession, path: str, shards: int = 1, shard: int | None = None):
    """A stream (place, shard, text) of the texts that arrive in the folder: text, or else content; rows with neither have a
    place, but don't come. shard is the place modulo shards."""
    spark.dataSource.register(ShardedTexts)
    reader = spark.readStream.format(NAME).option("path", path).option("shards", shards)
    if shard is not None:
        reader = reader.option("shard", shard)
    return reader.load()
