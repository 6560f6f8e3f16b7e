"""File sinks: JSON lines, CSV with run columns, one folder per route, manifests and small reports."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.protocol import failure_analysis


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, other than ASCII letters as they are, null fields kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, instance: str, patch: str, model: str) -> None:
    """Patches as prediction lines: instance_id, model_name_or_path and model_patch; a null patch is an empty one."""
    named = [F.col(instance).cast("string").alias("instance_id"), F.lit(model).alias("model_name_or_path"), F.coalesce(F.col(patch), F.lit("")).alias("model_patch")]
    write_json_lines(df.select(*named), path)


def write_csv(df: DataFrame, path: str, label: str | None = None, stamp: str | None = None) -> None:
    """CSV with a header, quotes doubled; label and stamp become the columns run_label and timestamp."""
    more = {k: F.lit(v) for k, v in (("run_label", label), ("timestamp", stamp)) if v is not None}
    df.withColumns(more).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, emptyValue="")


def write_failure_analysis(runs: dict[str, DataFrame], path: str) -> None:
    write_csv(failure_analysis(runs), path)


def write_by_route(df: DataFrame, route: str, path: str) -> None:
    """One folder <route>=<value> for each value; a null route has a folder of its own."""
    df.write.mode("overwrite").partitionBy(route).json(path)


def manifest(df: DataFrame, key: str) -> dict:
    """What a build holds: rows, distinct keys and rows by key (keys are categories, a short list)."""
    rows = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(key).collect()
    return {"total": sum(r["n"] for r in rows), "keys": len(rows), "by_key": {str(r[key]): r["n"] for r in rows}}


def write_report(spark, report: dict, path: str) -> None:
    """A small report as one JSON document, in any store that Spark writes to."""
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def console_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): each row as columns of fixed width, cut or filled with spaces; numbers stand at the right."""
    numeric = {c for c, k in df.dtypes if k in ("int", "bigint", "double", "float")}
    cell = lambda c, n: (F.lpad if c in numeric else F.rpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")
    return df.select(F.concat_ws("  ", *[cell(c, n) for c, n in widths.items()]).alias("line"))
