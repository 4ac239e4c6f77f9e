"""Append-once streams: replays, later files, and a lost checkpoint."""

from pyspark.sql import functions as F

from veridelta.streaming.append import append_once


def test_each_key_is_written_once(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    files, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
    read = lambda: sorted(r.k for r in spark.read.parquet(out).select("k").collect())
    add([(1, "a"), (2, "b"), (2, "b")])
    add([(2, "again"), (3, "c")])
    append_once(stream(), ["k"], out, f"{tmp_path}/one", schema)
    assert read() == [1, 2, 3]
    append_once(stream(), ["k"], out, f"{tmp_path}/one", schema)
    assert read() == [1, 2, 3]
    add([(3, "late"), (4, "d")])
    append_once(stream(), ["k"], out, f"{tmp_path}/one", schema)
    assert read() == [1, 2, 3, 4]
    # another checkpoint meets all files anew
    append_once(stream(), ["k"], out, f"{tmp_path}/two", schema)
    assert read() == [1, 2, 3, 4]
    assert spark.read.parquet(out).where(F.col("k") == 4).first().v == "d"
