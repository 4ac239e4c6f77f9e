"""Append-with-resume as a stream: each key is written once, whatever is replayed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_once(source: DataFrame, keys: list[str], path: str, checkpoint: str, schema: T.StructType) -> None:
    """Run a stream over what is there now, appending to the Parquet table at ``path`` the rows whose keys aren't in it.

    The table has a folder for each checkpoint (``run``) and micro-batch (``batch``). A key that the stream has met is held in
    its state, spread over the executors, so a batch reads no rows of its own run again; a batch that is run again after a
    failure overwrites its own folder. Only keys that other runs have written are looked up in the table."""
    spark: SparkSession = source.sparkSession
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    whole = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, n: int) -> None:
        # the run is a folder: files of this one aren't opened
        done = spark.read.schema(whole).option("ignoreMissingFiles", True).parquet(path).where(F.col("run") != own)
        new = batch.join(done.select(*keys), keys, "left_anti").select(*schema.fieldNames())
        new.write.mode("overwrite").parquet(f"{path}/run={own}/batch={n}")

    # a table that isn't there yet; beside others, a folder without rows
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/run={own}/batch=-1")
    once = source.dropDuplicates(keys)
    query = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
