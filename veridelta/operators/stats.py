"""Rank statistics and calibration."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(counts: DataFrame, value: str, score: str | None, n: int) -> Column:
    """The bounds of ``n`` ranges of value, for each score its own: approximate quantiles, from one job for all scores."""
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    own = F.percentile_approx(F.col(value).cast("double"), shares, F.lit(10 * n)).alias("q")
    found = counts.groupBy(F.col(score) if score else F.lit("").alias("k")).agg(own).collect()  # a row for each score
    known = {r[0]: sorted(set(r["q"])) for r in found if r["q"]}
    if not known:
        return F.array().cast("array<double>")
    bounds = [F.array(*[F.lit(b) for b in bs]) for bs in known.values()]
    if not score:
        return bounds[0]
    return F.create_map(*[c for k, b in zip(known, bounds) for c in (F.lit(k), b)])[F.col(score)]


def _place(bounds: Column, value: Column, n: int) -> Column:
    """How many of at most ``n`` sorted bounds lie below a value, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    # past the last bound there is null, which isn't below
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def running_totals(counts: DataFrame, by: list[str], value: str, sums: list[str], score: str | None = None) -> DataFrame:
    """``counts`` (by, value, sums), one row for each value, with ``upto_<sum>``: the sum over values no greater in the group.

    Rows are dealt out by ranges of value, summed within their range, and shifted by the sums of the ranges before: a group of
    any size is no single task's. There is a range for each shuffle partition; with ``score``, one of ``by`` that has few
    values, each score has ranges of its own."""
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = _place(_bounds(counts, value, score, n), F.col(value), n) if n > 1 else F.lit(0)
    dealt = counts.withColumn("__range", place)
    whole = dealt.groupBy("__range", *by).agg(*[F.sum(s).alias(f"__{s}") for s in sums])
    # a row for each range that a group has values in
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = whole.select("__range", *by, *[F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__{s}") for s in sums])
    within = Window.partitionBy("__range", *by).orderBy(value)
    own = dealt.withColumns({f"upto_{s}": F.sum(s).over(within) for s in sums})
    condition = F.col("l.__range") == F.col("r.__range")
    for c in by:
        condition &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = own.alias("l").join(shifts.alias("r"), condition)
    upto = [(F.col(f"l.upto_{s}") + F.col(f"r.__{s}")).alias(f"upto_{s}") for s in sums]
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in counts.columns], *upto)


#: A value is frequent if more than one row in so many has it: that bounds the number of frequent values.
FREQUENT = 1000
#: Parts that the rows of a frequent value are dealt into.
PARTS = 64


def midranks(df: DataFrame, value: str, by: list[str], name: str = "midrank") -> DataFrame:
    """Ranks with ties at their mean, within each group.

    Ranked through the counts of distinct values, so that rows that tie never meet; null values have no rank. Ranks are joined
    back by value; the rows of a frequent value are dealt into parts, each with a copy of its rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    totals = running_totals(counts, by, value, ["__n"])
    size = counts.agg(F.sum("__n").alias("__all"))
    ranks = totals.crossJoin(F.broadcast(size)).select(
        *by, value, (F.col("upto___n") - (F.col("__n") - 1) / 2.0).alias(name), (F.col("__n") * FREQUENT > F.col("__all")).alias("__frequent")
    )
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] + [F.col(f"{a}.{value}") == F.col(f"{b}.{value}")]
    frequent = counts.crossJoin(F.broadcast(size)).where(F.col("__n") * FREQUENT > F.col("__all")).select(*by, value, F.lit(True).alias("__many"))
    # fewer than FREQUENT rows
    rows = df.alias("l").join(F.broadcast(frequent).alias("m"), reduce(and_, same("l", "m")), "left")
    part = F.when(F.col("m.__many"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    rows = rows.select("l.*", part.alias("__part"))
    parts = F.when(F.col("__frequent"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    ranks = ranks.withColumn("__part", F.explode(parts))
    joined = rows.alias("l").join(ranks.alias("r"), reduce(and_, [*same("l", "r"), F.col("l.__part") == F.col("r.__part")]))
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], f"r.{name}")


def aurocs(df: DataFrame, scores: dict[str, str], positive: str, by: list[str]) -> DataFrame:
    """(by, score, auroc, n_positive, n_negative) for each named score column: the probability that a positive outranks a
    negative, ties half; null for a single class. A row counts for the scores that it has.

    Only counts by distinct value are ordered, of all scores at once."""
    p, n = F.sum("__p"), F.sum("__q")
    named = F.array(*[F.struct(F.lit(k).alias("score"), F.col(c).cast("double").alias("__v")) for k, c in scores.items()])
    rows = df.select(*by, F.col(positive).alias("__y"), F.explode(named).alias("s")).where("s.__v is not null").select(*by, "__y", "s.*")
    counts = rows.groupBy(*by, "score", "__v").agg(
        F.sum(F.when(F.col("__y"), 1).otherwise(0)).alias("__p"), F.sum(F.when(F.col("__y"), 0).otherwise(1)).alias("__q")
    )
    totals = running_totals(counts, [*by, "score"], "__v", ["__q"], "score")
    wins = totals.withColumn("__w", F.col("__p") * (F.col("upto___q") - F.col("__q") / 2.0))
    return wins.groupBy(*by, "score").agg(
        F.when((p > 0) & (n > 0), F.sum("__w") / (p * n)).alias("auroc"), p.alias("n_positive"), n.alias("n_negative")
    )


def auroc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """(by, auroc, n_positive, n_negative) of one score."""
    return aurocs(df, {"": score}, positive, by).drop("score")


def delong(df: DataFrame, first: str, second: str, positive: str) -> DataFrame:
    """One row: both AUROCs, their difference, its z and two-sided p by the fast paired DeLong test.

    p is null where the variance isn't positive."""
    base = df.select(F.col(first).cast("double").alias("__a"), F.col(second).cast("double").alias("__b"), F.col(positive).cast("int").alias("__y"))
    base = base.where(F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__y").isNotNull())
    sizes = base.groupBy("__y").count().collect()
    m = {r["__y"]: r["count"] for r in sizes}
    if not m.get(1) or not m.get(0):
        return base.sparkSession.range(1).select(
            *[F.lit(None).cast("double").alias(c) for c in ("auc_a", "auc_b", "difference", "z", "p_value")]
        )
    # both scores' values at once: how many of each class there are, and how many up to each value
    scores = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("v")) for k in "ab"]))
    counts = base.select("__y", scores.alias("s")).groupBy(F.col("s.k").alias("k"), F.col("s.v").alias("v"))
    counts = counts.agg(F.sum("__y").alias("p"), F.sum(1 - F.col("__y")).alias("q"))
    totals = running_totals(counts, ["k"], "v", ["p", "q"], "k")
    # a positive's placement: the share of negatives below it, ties half; a negative's: of positives above it
    for k in "ab":
        own = totals.where(F.col("k") == k).select(
            F.col("v").alias(f"__v{k}"),
            ((F.col("upto_q") - F.col("q") / 2) / m[0]).alias(f"__n{k}"),
            (1 - (F.col("upto_p") - F.col("p") / 2) / m[1]).alias(f"__p{k}"),
        )
        base = base.join(own, F.col(f"__{k}") == F.col(f"__v{k}"))
    place = lambda k: F.when(F.col("__y") == 1, F.col(f"__n{k}")).otherwise(F.col(f"__p{k}"))
    placed = base.select("__y", place("a").alias("__va"), place("b").alias("__vb"))
    gap = F.col("__va") - F.col("__vb")
    of = lambda y, c: F.when(F.col("__y") == y, c)
    row = placed.agg(
        F.avg(of(1, F.col("__va"))).alias("auc_a"),
        F.avg(of(1, F.col("__vb"))).alias("auc_b"),
        (F.var_samp(of(1, gap)) / m[1] + F.var_samp(of(0, gap)) / m[0]).alias("__v"),
    )
    row = row.withColumn("difference", F.col("auc_a") - F.col("auc_b"))
    row = row.withColumn("z", F.when(F.col("__v") > 0, F.col("difference") / F.sqrt("__v"))).drop("__v")

    return row.withColumn("p_value", two_sided(F.abs("z")))


def two_sided(z: Column) -> Column:
    """The chance that a standard normal number lies farther from 0 than ``z`` >= 0: by the series of its integral below 3, by
    the continued fraction above."""
    half = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    step = lambda a, i: a["t"] * z * z / (2 * i + 1)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(z.alias("t"), z.alias("s")),
        lambda a, i: F.struct(step(a, i).alias("t"), (a["s"] + step(a, i)).alias("s")),
    )["s"]
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda t, i: z + i / t)
    return F.when(z < 3, 1 - 2 * half * series).otherwise(2 * half / tail)


def conclusion(p_value: Column, difference: Column, level: float = 0.05) -> Column:
    """What the test says."""
    better = F.when(difference > 0, "the first score ranks better").otherwise("the second score ranks better")
    return F.when(p_value.isNull(), "the variance isn't positive: no test").when(p_value < level, better).otherwise(
        "no difference can be told"
    )


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n, confidence, accuracy, gap) of every bin; the last bin is closed, empty ones are zeros."""
    spark = df.sparkSession
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    width = 1.0 / bins
    # the bin by multiplication, then set right against the true edges
    guess = F.least(F.lit(bins - 1), F.floor(c * bins)).cast("int")
    guess = F.when(c < guess * F.lit(width), guess - 1).when((c >= (guess + 1) * F.lit(width)) & (guess < bins - 1), guess + 1).otherwise(guess)
    own = df.where(F.col(confidence).isNotNull()).select(guess.alias("bin"), c.alias("__c"), F.col(correct).cast("double").alias("__y"))
    filled = own.groupBy("bin").agg(F.count("*").alias("n"), F.avg("__c").alias("confidence"), F.avg("__y").alias("accuracy"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = edges.join(F.broadcast(filled), "bin", "left")  # at most one row for each bin
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.select(
        "bin",
        (F.col("bin") * F.lit(width)).alias("low"),
        ((F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        zero(F.col("confidence")).alias("confidence"),
        zero(F.col("accuracy")).alias("accuracy"),
        zero(F.abs(F.col("confidence") - F.col("accuracy"))).alias("gap"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected and maximum calibration error of a table of bins."""
    return bins.agg(
        F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.nullif(F.sum("n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("mce"),
    )
