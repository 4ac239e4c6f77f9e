"""Image files as base64 columns, joined to the chunks that name them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions.layout import image_base64, mime_type

#: Bytes of an image at most; a larger file is an error, never a part of it.
MOST_BYTES = 20 << 20


def image_files(spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(name, mime, content): the files under ``folder``, by their path within it; one over ``most_bytes`` is an error. Spark
    leaves out files without a byte, so these count as missing."""
    bare = re.sub(r"^[a-z0-9]+:/*", "/", folder).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring("path", F.instr("path", bare) + len(bare), F.length("path"))
    said = F.concat(F.col("path"), F.lit(": "), F.col("length").cast("string"), F.lit(f" bytes, of at most {most_bytes}"))
    content = F.when(F.col("length") <= most_bytes, F.col("content")).otherwise(F.raise_error(said).cast("binary"))
    return files.select(name.alias("name"), mime_type(F.col("path")).alias("mime"), content.alias("content"))


def with_images(chunks: DataFrame, files: DataFrame, image: str = "image") -> DataFrame:
    """``chunks`` with ``mime`` and, where their ``image`` names a file, its content in base64; other images, urls and base64
    alike, stay as given, with a null type. Files are joined by name, so a file that many chunks name is one key, which both
    sides are dealt out for (the second key says nothing new) and adaptive execution may split."""
    own = files.select(F.col("name").alias("__name"), F.col("mime").alias("__mime"), image_base64(F.col("content")).alias("__file"))
    same = (F.col(image) == F.col("__name")) & (F.xxhash64(image) == F.xxhash64("__name"))
    rows = chunks.drop("mime").join(own, same, "left")
    others = [F.col(c) for c in chunks.columns if c not in (image, "mime")]
    return rows.select(*others, F.coalesce("__file", image).alias(image), F.col("__mime").alias("mime"))
