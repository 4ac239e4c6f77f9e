"""Classes of equivalent samples within a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.operators.components import connected_components


def both_ways(scores: DataFrame, query: str, threshold: float = 0.5) -> DataFrame:
    """(query, i, j), i < j: pairs whose entailment holds in both directions. ``scores`` (query, i, j, entailment)."""
    held = scores.where(F.col("entailment") >= threshold)
    low, high = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    return held.where("i <> j").select(query, low, high).groupBy(query, "i", "j").count().where("count >= 2").drop("count")


def contradicts(score: Column, threshold: float = 0.5) -> Column:
    """Whether a statement contradicts another, in the direction given."""
    return score >= threshold


def directed_pairs(samples: DataFrame, query: str, sample: str, text: str, question: str) -> DataFrame:
    """(query, i, j, premise, hypothesis) of every two different samples of a question, each way, the question before each text.

    A question has the few samples that were drawn for it."""
    own = samples.select(F.col(query).alias("query"), F.col(sample).alias("i"), F.concat_ws(" ", question, text).alias("premise"))
    other = own.select("query", F.col("i").alias("j"), F.col("premise").alias("hypothesis"))
    return own.join(other, "query").where("i <> j")


def both_entail(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(query, i, j, equal) of directed pairs (query, i, j, entailment): equal where both ways hold."""
    back = scores.select("query", F.col("i").alias("j"), F.col("j").alias("i"), F.col("entailment").alias("back"))
    held = (F.col("entailment") >= threshold) & (F.col("back") >= threshold)
    return scores.join(back, ["query", "i", "j"], "left").select("query", "i", "j", F.coalesce(held, F.lit(False)).alias("equal"))


def equivalent(forward: Column, backward: Column, strict: bool = True) -> Column:
    """Whether two answers mean the same by their labels (entailment, neutral, contradiction) in both directions: strictly,
    if both entail; loosely, if neither contradicts and not both are neutral."""
    if strict:
        return (forward == "entailment") & (backward == "entailment")
    none = (forward != "contradiction") & (backward != "contradiction")
    return none & ~((forward == "neutral") & (backward == "neutral"))


def concepts(samples: DataFrame, edges: DataFrame, query: str, sample: str) -> DataFrame:
    """(query, sample, concept, size, probability): transitive classes of a question's samples.

    ``edges`` (query, i, j) link samples. Concepts are numbered by falling size, ties by their first sample. Components are
    found over all questions together, so a question with very many samples is no single task's."""
    own = samples.select(F.col(query).alias("q"), F.col(sample).alias("s")).distinct()
    node = lambda s: F.struct(F.col(query).alias("q"), F.col(s).cast("long").alias("s"))
    found = connected_components(edges.select(node("i").alias("a"), node("j").alias("b")), "a", "b")
    found = found.select(F.col("node.q").alias("l_q"), F.col("node.s").alias("l_s"), F.col("component.s").alias("least"))
    joined = own.join(found, F.col("q").eqNullSafe(F.col("l_q")) & (F.col("s") == F.col("l_s")), "left")
    joined = joined.select("q", "s", F.coalesce("least", F.col("s").cast("long")).alias("first"))
    # one row for each class, not for each sample
    sizes = joined.groupBy(F.col("q").alias("c_q"), F.col("first").alias("c_first")).agg(F.count("*").alias("size"))
    by_size = Window.partitionBy("c_q").orderBy(F.col("size").desc(), "c_first")
    sizes = sizes.withColumn("concept", F.row_number().over(by_size) - 1)
    sizes = sizes.withColumn("probability", F.col("size") / F.sum("size").over(Window.partitionBy("c_q")))
    both = joined.join(sizes, F.col("q").eqNullSafe(F.col("c_q")) & (F.col("first") == F.col("c_first")))
    return both.select(F.col("q").alias(query), F.col("s").alias(sample), "concept", "size", "probability")


def greedy_classes(pairs: DataFrame, query: str, n_samples: str) -> DataFrame:
    """(query, classes): the class of each of a question's samples when only first samples are compared with.

    ``pairs`` (query, n, i, j, equal). A sample is the first of a class if it equals no earlier first sample; every other one
    belongs to the latest first sample before it that it equals, so the result depends on the order and isn't transitive. A
    question has as many samples as were drawn for it, a few tens."""
    equal = F.when(F.col("equal") & (F.col("i") < F.col("j")), F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")))
    own = pairs.groupBy(query).agg(F.max(n_samples).cast("int").alias("n"), F.collect_set(equal).alias("e"))
    is_equal = lambda i, j: F.array_contains(F.col("e"), F.struct(i.alias("i"), j.alias("j")))
    places = F.sequence(F.lit(0), F.col("n") - 1)
    firsts = F.aggregate(
        places,
        F.lit([]).cast("array<int>"),
        lambda done, j: F.when(F.exists(done, lambda i: is_equal(i, j)), done).otherwise(F.concat(done, F.array(j))),
    )
    own = own.withColumn("firsts", firsts)
    leader = lambda j: F.coalesce(
        F.when(F.array_contains("firsts", j), j),
        F.array_max(F.filter("firsts", lambda i: (i < j) & is_equal(i, j))),
    )
    classes = F.transform(places, lambda j: (F.array_position("firsts", leader(j)) - 1).cast("int"))
    return own.select(query, classes.alias("classes"))


def first_by(df: DataFrame, by: str, order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__r = 1").drop("__r")
