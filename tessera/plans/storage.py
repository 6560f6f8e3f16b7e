"""Working tables in the folder that every executor sees."""

import tempfile
import uuid

_own: dict[str, str] = {}  # the folder of local sessions without spark.checkpoint.dir

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in a local session without one (tests) a temporary one, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        base = _own["dir"]
    return base.rstrip("/")


def working_dir(spark: SparkSession) -> str:
    """This application's own folder of working tables; others that share the folder above have theirs."""
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: what was computed once stays the same for all that read it, whatever
    executors are lost. The caller removes what it no longer needs (remove_stored)."""
    spark = df.sparkSession
    path = f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Removes all working tables of this application. Only when no query that reads one is still to run."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(working_dir(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
