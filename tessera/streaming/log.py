"""Append logs that streams write, each batch once: with resume, and a stop after so many rows.

A batch goes to a folder of its own number, and then a small file says that it is whole, how many rows it has and how
many the log has with it. A batch that is sent again, as after a crash between the two, replaces what it wrote; one that
was committed isn't written again. Readers take committed batches only.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..store.folder import Folder


class AppendLog:
    """The log at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def committed(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("_commits") if n.endswith(".json")]

    def total(self, before: int | None = None) -> int:
        """The rows of all committed batches, or of those before a number; one small file is read."""
        numbers = [n for n in self.committed() if before is None or n < before]
        return json.loads(self.folder.read(f"_commits/{numbers[-1]:012d}.json"))["total"] if numbers else 0

    def write(self, batch: DataFrame, number: int, most: int | None = None) -> bool:
        """Writes a batch, no more of it than leaves the log with most rows; False if it is there already."""
        if number in self.committed():
            return False
        had = self.total(number)
        place = f"{self.folder.path}/batch={number}"
        kept = batch if most is None else batch.limit(max(0, most - had))
        kept.write.mode("overwrite").parquet(place)
        rows = self.spark.read.schema(batch.schema).parquet(place).count()
        self.folder.commit(f"_commits/{number:012d}.json", json.dumps({"rows": rows, "total": had + rows}))
        return True

    def read(self, schema) -> DataFrame:
        """The rows of all committed batches."""
        paths = [f"{self.folder.path}/batch={n}" for n in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def start(self, stream: DataFrame, checkpoint: str, resume: bool = True, most: int | None = None, every: str | None = None) -> StreamingQuery:
        """Appends the stream to the log: what is there and then ends, or every so often ("10 seconds") until stopped.

        resume: goes on where the checkpoint stands; else log and checkpoint start anew. most: rows after which nothing
        more is kept, over all batches and restarts.
        """
        if not resume:
            self.folder.delete()
            Folder(self.spark, checkpoint).delete()
        log = AppendLog(self.spark, self.folder.path)

        def write(batch: DataFrame, number: int) -> None:
            log.write(batch, number, most)

        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
