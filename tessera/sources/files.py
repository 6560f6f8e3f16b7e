"""Text sources: JSON lines with their ways of treating bad rows, CSV files, listings and fallbacks."""

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scanners import parsed

PROBLEM = "_corrupt_record"


def is_json(line: Column) -> Column:
    """Whether a line is exactly one JSON object; from_json alone takes single quotes and what follows an object."""

    @F.pandas_udf("boolean")
    def check(lines: pd.Series) -> pd.Series:
        return lines.fillna("").map(lambda x: isinstance(parsed(x)[0], dict))

    return check(line)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of every line of the files at path; read in splits, so lines have no number."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line), numbered from 1. Each file is read by one task as one row: for task lists, not for corpora."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("number"), "line")


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The parsed columns of each line that is neither blank nor a # comment, with the columns that lines has besides
    line, and _corrupt_record, which holds a line that isn't one JSON object."""
    others = [c for c in lines.columns if c != "line"]
    line = F.trim("line", F.lit(" \t\r\n\x0b\x0c"))
    said = lines.select(*others, line.alias("line")).where("line <> '' and not startswith(line, '#')")
    parsed_ = said.withColumns({"x": F.from_json("line", schema, {"mode": "PERMISSIVE"}), PROBLEM: F.when(~is_json(F.col("line")), F.col("line"))})
    return parsed_.select(*others, "x.*", PROBLEM)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line that is neither blank nor a # comment, with its file and _corrupt_record (null if it parsed)."""
    return parse_lines(text_lines(spark, path), schema)


def lenient(rows: DataFrame) -> DataFrame:
    """Rows that parsed."""
    return rows.where(F.col(PROBLEM).isNull()).drop(PROBLEM)


def strict(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows; reading one that didn't parse, or lacks a required field, raises an error that names file and line.

    The check is a filter, so no projection or count leaves it out. required: names, or alternatives joined by |.
    """
    lacks = lambda names: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names.split("|")]).isNull()
    where = F.concat(F.lit("bad row in "), F.col("file"), *([F.lit(":"), F.col("number").cast("string")] if "number" in rows.columns else []))
    error = F.when(F.col(PROBLEM).isNotNull(), F.concat(where, F.lit(": invalid JSON: "), F.left(PROBLEM, F.lit(200))))
    for names in required:
        error = F.coalesce(error, F.when(lacks(names), F.concat(where, F.lit(f": no {names}"))))
    return rows.where(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True)).drop(PROBLEM)


def judged(rows: DataFrame, required: list[str]) -> DataFrame:
    """rows with status: json_error, FAIL (a required field is missing or empty) or OK."""
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.coalesce(F.col(c) == "", F.lit(True))
    return rows.withColumn("status", F.when(F.col(PROBLEM).isNotNull(), "json_error").when(lacking, "FAIL").otherwise("OK"))


def gate_report(rows: DataFrame, required: list[str]) -> DataFrame:
    """(file, total, failed, valid): lines that don't parse count as failed but not in the total."""
    s = F.col("status")
    return judged(rows, required).groupBy("file").agg(F.count_if(s != "json_error").alias("total"), F.count_if(s != "OK").alias("failed"), F.count_if(s == "OK").alias("valid"))


def gate_verdict(rows: DataFrame, required: list[str]) -> DataFrame:
    """(failed, valid, verdict) over all files: any failure aborts, as does the lack of valid records."""
    s = F.col("status")
    both = judged(rows, required).agg(F.count_if(s != "OK").alias("failed"), F.count_if(s == "OK").alias("valid"))
    stop = F.when(F.col("failed") > 0, F.concat(F.lit("ABORT: "), F.col("failed").cast("string"), F.lit(" record(s) failed validation")))
    return both.withColumn("verdict", F.coalesce(stop, F.when(F.col("valid") == 0, "ABORT: no valid records").otherwise("OK")))


def gated(rows: DataFrame, required: list[str]) -> DataFrame:
    """The valid rows; an error if any row of any file fails, or none is valid. The files are read twice."""
    verdict = gate_verdict(rows, required).first()["verdict"]  # one row
    if verdict != "OK":
        raise ValueError(verdict)
    return lenient(rows)


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header, every value text, quotes doubled, empty values the empty text."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, multiLine=True, escape='"')
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def csv_typed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose column types are taken from its values; a path that holds nothing raises an error."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of paths that exists in its store and isn't empty."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(place) and fs.getContentSummary(place).getLength() > 0:
            return path
    return None


def below(root: str, path: str) -> str:
    """path, taken from root, as a path of its own; ValueError if it leaves root. A path that begins with root is taken as
    one below it."""
    own = posixpath.normpath(root)
    inner = path[len(own) + 1 :] if path == own or path.startswith(f"{own}/") else path
    found = posixpath.normpath(posixpath.join(own, inner))
    if found != own and not found.startswith(f"{own}/"):
        raise ValueError(f"path {path!r} leaves {root}")
    return found


def listing_below(spark: SparkSession, root: str, path: str = ".", most: int = 500) -> DataFrame:
    """listing() of a folder that must lie below root."""
    scheme, sep, rest = root.rpartition("://") if "://" in root else ("", "", root)
    return listing(spark, f"{scheme}{sep}{below(rest, path)}", most)


def existing(spark: SparkSession, paths: list[str], required: bool = False) -> list[str]:
    """Those of paths that exist and aren't empty, in order; with required, FileNotFoundError if there is none."""
    found = [p for p in paths if first_existing(spark, [p])]
    if required and not found:
        raise FileNotFoundError(f"none of {', '.join(paths)} holds anything")
    return found


def listing(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """(path, size) of the first files below path, in the order of their paths; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size")).orderBy("path").limit(most)
