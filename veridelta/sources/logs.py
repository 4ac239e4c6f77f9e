"""Logs of steps and costs as a table in parts by key: appended to, begun anew for some keys, read for some keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that figures of a log are rounded to.
PLACES = 6


def _rounded(rows: DataFrame) -> DataFrame:
    figures = {n: F.round(n, PLACES) for n, kind in rows.dtypes if kind in ("double", "float")}
    return rows.withColumns(figures) if figures else rows


def append_log(rows: DataFrame, folder: str, key: str) -> None:
    """Rows, such as steps or calls with their costs, added to the log, figures rounded. A key's rows are few: one file each."""
    _rounded(rows).repartition(key).write.mode("append").partitionBy(key).parquet(folder)


def restart_log(rows: DataFrame, folder: str, key: str) -> None:
    """The logs of the keys of ``rows`` begun anew with these rows; the files of other keys aren't touched."""
    writer = _rounded(rows).repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key).parquet(folder)


def history(spark: SparkSession, folder: str, schema, key: str, *keys) -> DataFrame:
    """The rows of a log, of some keys or of all; only the parts of these keys are read."""
    rows = spark.read.schema(schema).parquet(folder)
    return rows.where(F.col(key).isin(*keys)) if keys else rows
