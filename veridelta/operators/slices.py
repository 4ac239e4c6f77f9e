"""Places in a stated order over a whole table, and slices by them, without bringing the table to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.session import written


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in an order, from 0.

    Rows are dealt out by ranges and sorted within them; a range's rows are numbered where they are and shifted by the sizes of
    the ranges before it, one number a range. Rows that are equal in the order come in any order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # written once, so that ranges and places stay as they are
    rows = written(ranged.withColumns({"__range": F.spark_partition_id(), "__inside": inside}), "ranged")
    sizes = rows.groupBy("__range").count().collect()  # one row a range
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r["__range"]):
        starts.append((r["__range"], at))
        at += r["count"]
    shifts = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    out = rows.join(F.broadcast(shifts), "__range")
    return out.withColumn(name, F.col("__start") + F.col("__inside")).select(*df.columns, name)


def sliced(
    df: DataFrame, *order: str | Column, offset: int = 0, size: int | None = None, where: Column | None = None, limit: int | None = None
) -> DataFrame:
    """The rows from ``offset`` on, ``size`` of them, in an order; of these the ones that ``where`` keeps, the first ``limit`` of
    them. No bound: all."""
    own = numbered(df, *order, name="__place").where(F.col("__place") >= offset)
    if size is not None:
        own = own.where(F.col("__place") < offset + size)
    if where is not None:
        own = own.where(where)
    own = own.drop("__place")
    if limit is None:
        return own
    return numbered(own, *order, name="__place").where(F.col("__place") < limit).drop("__place")
