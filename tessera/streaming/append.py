"""Streaming twins: write-back of unseen records, and tumbling means of a training log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store.keyed import KeyedTable


def append_unseen(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to the Parquet table at target the first row of each key that it lacks; takes what is there and ends.

    Rows repeated in one batch are dropped by the batch, those of earlier batches by an anti join, so no state grows.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_means(stream: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """(start, mean, n) of each window of event time; rows later than the watermark are left out."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return windows.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select("w.start", "mean", "n")


def write_back(stream: DataFrame, table: KeyedTable, order: str, number: str, checkpoint: str, name: str = "write-back") -> StreamingQuery:
    """Adds to a keyed table the stream's rows whose key it lacks, numbered on from those it has; takes what is there and
    ends. A batch that is sent again adds nothing, and a batch reads only the buckets whose filters know one of its keys."""

    def write(batch: DataFrame, n: int) -> None:
        KeyedTable(batch.sparkSession, table.folder.path).append(batch, order, number, (name, n))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
