"""Queries of clustering, resumable output, reports and the question loops."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridelta.operators import cluster
from veridelta.plans.registry import query, table
from veridelta.session import checkpointed, shared_dir
from veridelta.sources import records
from veridelta.streaming.append import append_once


@query(
    "concepts",
    """WITH g AS (SELECT conv_id, role, min(turn) AS first, count(DISTINCT turn) AS k FROM conversations GROUP BY ALL),
    n AS (SELECT *, sum(k) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC, first) - 1 AS c FROM g)
    SELECT DISTINCT v.conv_id, v.turn, CAST(c AS INTEGER) AS concept, round(k / n, 6) AS probability
    FROM conversations v JOIN n ON n.conv_id = v.conv_id AND n.role = v.role""",
)
def concepts(spark, sf_dir):
    """Classes of every conversation's turns, linked where they share a role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    # a chain over each role's turns links as much as all its pairs
    after = F.lead("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    edges = turns.select("conv_id", F.col("turn").alias("i"), after.alias("j")).where("j is not null")
    found = cluster.concepts(turns, edges, "conv_id", "turn")
    return found.select("conv_id", "turn", "concept", F.round("probability", 6).alias("probability"))


def _rounded_means(rows, by, value):
    """The mean of each group to two digits as ``v``, as SQL has it: a sum of doubles in the order of the rows, and the binary
    product rounded, where Spark's round to two digits takes the number as it is shown (1.005 to 1.01).

    The order of a sum matters only where its error can reach a half. Those groups are read again and summed in the order of
    their rows, by a running sum that holds one row at a time; all others are summed before the shuffle."""
    x = F.avg(value) * 100
    # what two orders of a sum can differ by, and the rounding of quotient and product
    error = (F.count(value) + 4) * 2.0**-52 * 100 * F.avg(F.abs(value))
    means = rows.groupBy(*by).agg(x.alias("x"), (0.5 - F.abs(x - F.rint(x)) <= error).alias("unsure"))
    means = checkpointed(means)
    sure = means.where("unsure is null or not unsure").select(*by, (F.round("x") / 100).alias("v"))
    key = [F.col(c).alias(f"of_{c}") for c in by]
    same = lambda a: [F.col(c).eqNullSafe(a[f"of_{c}"]) for c in by]
    unsure = means.where("unsure").select(*key)
    own = rows.select(*by, value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    own = own.where(F.col(value).isNotNull()).join(unsure, same(unsure), "left_semi")
    window = Window.partitionBy(*by).orderBy("file", "at")
    own = own.select(
        *by,
        F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.row_number().over(window).alias("n"),
    )
    last = own.groupBy(*by).agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
    return checkpointed(sure.unionByName(last.select(*by, (F.round(F.col("total") / F.col("n") * 100) / 100).alias("v"))))


@query(
    "greedy_classes",
    """WITH v AS (SELECT user_id, event_type, round(avg(value), 2) AS v FROM events GROUP BY ALL),
    p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i, v FROM v),
    q AS (SELECT user_id, list(v ORDER BY i) AS v FROM p GROUP BY user_id HAVING count(*) > 1),
    f AS (SELECT *, list_reduce(range(0, len(v)), lambda a, j: CASE WHEN len(list_filter(a, lambda i: abs(v[i + 1] - v[j + 1]) < 2)) > 0
      THEN a ELSE list_append(a, j) END, CAST([] AS BIGINT[])) AS first FROM (SELECT user_id, v FROM q)),
    l AS (SELECT user_id, first, list_transform(range(0, len(v)), lambda j: CASE WHEN list_contains(first, j) THEN j
      ELSE list_max(list_filter(first, lambda i: i < j AND abs(v[i + 1] - v[j + 1]) < 2)) END) AS own FROM f)
    SELECT user_id, array_to_string(list_transform(own, lambda x: list_position(first, x) - 1), ',') AS classes FROM l""",
)
def greedy_classes(spark, sf_dir):
    """Order-dependent classes of every user's kinds of event by their mean value."""
    own = _rounded_means(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value")
    # events without a user are a group of their own in SQL
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("event_type").asc_nulls_last())) - 1
    own = own.select("user_id", place.alias("i"), "v")
    n = own.groupBy(F.col("user_id").alias("n_id")).agg(F.count("*").alias("n"))
    others = own.select(F.col("user_id").alias("other_id"), F.col("i").alias("j"), F.col("v").alias("w"))
    pairs = own.join(others, F.col("user_id").eqNullSafe(F.col("other_id"))).where("i <> j")
    pairs = pairs.join(n, F.col("user_id").eqNullSafe(F.col("n_id")))
    pairs = pairs.select("user_id", "n", "i", "j", (F.abs(F.col("v") - F.col("w")) < 2).alias("equal"))
    found = cluster.greedy_classes(pairs, "user_id", "n")
    return found.select("user_id", F.array_join(F.transform("classes", lambda x: x.cast("string")), ",").alias("classes"))


@query(
    "report_rollup",
    """SELECT coalesce(role, 'overall') AS role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations,
      round(avg(length(coalesce(text, ''))), 6) AS mean_length FROM conversations GROUP BY ROLLUP (role)""",
)
def report_rollup(spark, sf_dir):
    """Counts and lengths of turns by role, and over all."""
    rows = table(spark, sf_dir, "conversations").select("role", "conv_id", F.length(F.coalesce("text", F.lit(""))).alias("l"))
    own = rows.rollup("role").agg(
        F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"), F.round(F.avg("l"), 6).alias("mean_length")
    )
    return own.withColumn("role", F.coalesce("role", F.lit("overall")))


@query(
    "resume",
    "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def resume(spark, sf_dir):
    """The documents without a label yet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return records.unfinished(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "merge_scores",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS BIGINT) ELSE d.n_chars END AS n_chars, l.toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def merge_scores(spark, sf_dir):
    """A left merge in which the right side's column wins."""
    base = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    more = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"), "toxic")
    return records.merged(base, more, "doc_id").select("doc_id", "n_chars", "toxic")


@query(
    "stream_append",
    "SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY user_id",
)
def stream_append(spark, sf_dir):
    """Events through an append-once stream, run twice over; each is counted once."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = events.schema
    for run in ("one", "two"):
        source = spark.readStream.schema(table(spark, sf_dir, "events").schema)
        source = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        append_once(source.select("event_id", "user_id", "value"), ["event_id"], f"{folder}/out", f"{folder}/{run}", schema)
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
