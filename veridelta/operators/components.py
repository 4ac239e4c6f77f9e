"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.session import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with ``m``, the least of a and its neighbours.

    The least is pre-aggregated on the map side and joined back, so that a hub's edges never meet in one task. The second
    key says nothing new; with it both sides are dealt out for the join alone, which can then be split where it is skewed."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "hub")
    least = least.withColumn("m", F.least("hub", "m"))
    same = (edges.a == least.hub) & (F.xxhash64(edges.a) == F.xxhash64(least.hub))
    return edges.join(least, same).select("a", "b", "m")


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Self-loops and repeated edges do no harm; edges with a null end are dropped; no edges give no rows. A node without
    any real edge to another node is left out: it is its own component. Large-star and small-star rounds run until the
    edges stand still; each round cuts its lineage in the shared folder."""
    a, b = F.col(src), F.col(dst)
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        a.isNotNull() & b.isNotNull() & (a != b)
    )
    edges = checkpointed(edges.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _least(large.distinct())
        hooked = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        rooted = small.select("a", F.col("m").alias("b"))
        edges = checkpointed(hooked.unionByName(rooted).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
