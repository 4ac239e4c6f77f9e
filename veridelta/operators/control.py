"""Routing, thresholds, pruning, convergence, retrieval triggers and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.text import ANSWER_PREFIX, SPACE, stripped


def route(se: Column, u: Column, tau_semantic: Column, tau_token: Column) -> Column:
    """RETRIEVE above the semantic threshold, else PRUNE above the token threshold, else STOP."""
    return F.when(se > tau_semantic, "RETRIEVE").when(u > tau_token, "PRUNE").otherwise("STOP")


def rationale(se: Column, u: Column, tau_semantic: Column, tau_token: Column) -> Column:
    """A struct of the decision, the figures it rests on, rounded to 4 places, and a sentence that explains it."""
    decision = route(se, u, tau_semantic, tau_token)
    said = lambda template, *values: F.format_string(template, *values)
    reason = (
        F.when(
            decision == "STOP",
            said("semantic entropy %.4f is at most %.4f and token uncertainty %.4f at most %.4f: the answer is certain", se, tau_semantic, u, tau_token),
        )
        .when(
            decision == "PRUNE",
            said("semantic entropy %.4f is at most %.4f but token uncertainty %.4f is above %.4f: the context needs pruning", se, tau_semantic, u, tau_token),
        )
        .otherwise(said("semantic entropy %.4f is above %.4f: new evidence is needed", se, tau_semantic))
    )
    figures = {"se_semantic": se, "u_token": u, "tau_semantic": tau_semantic, "tau_token": tau_token}
    return F.struct(decision.alias("decision"), *[F.round(c, 4).alias(n) for n, c in figures.items()], reason.alias("reason"))


def adaptive_threshold(first: Column, factor: float, floor: float) -> Column:
    """A share of the first iteration's value, not below a floor."""
    return F.greatest(first * F.lit(factor), F.lit(floor))


def thresholds(profiles: DataFrame, by: str, order: str, factors: tuple[float, float], floors: tuple[float, float]) -> DataFrame:
    """``profiles`` (by, order, se, u) with the thresholds of their first row: ``tau_semantic``, ``tau_token`` and whether
    they are calibrated yet, which the first row itself isn't."""
    w = Window.partitionBy(by).orderBy(order)
    first = lambda c: F.first(c).over(w)
    return profiles.withColumns(
        {
            "tau_semantic": adaptive_threshold(first("se"), factors[0], floors[0]),
            "tau_token": adaptive_threshold(first("u"), factors[1], floors[1]),
            "calibrated": F.row_number().over(w) > 1,
        }
    )


def samples_to_draw(questions: DataFrame, m: int, m_initial: int, m_max: int, adaptive: bool, se: str | None = None) -> DataFrame:
    """(.., sample): one row for each sample that is still to be drawn: ``m`` of each question; if ``adaptive``, the first
    ``m_initial``, or with ``se``, the entropy of those, the rest up to ``m_max`` where they disagree."""
    check_adaptive(adaptive, m_initial, m_max)
    if not adaptive:
        first, last, rows = 0, m - 1, questions
    elif se is None:
        first, last, rows = 0, m_initial - 1, questions
    else:
        first, last, rows = m_initial, m_max - 1, questions.where(escalates(F.col(se)))
    return rows.withColumn("sample", F.explode(F.sequence(F.lit(first), F.lit(last))))


def check_adaptive(adaptive: bool, m_initial: int, m_max: int) -> None:
    """The first draw must be smaller than the largest."""
    if adaptive and m_initial >= m_max:
        raise ValueError(f"m_initial ({m_initial}) must be less than m_max ({m_max})")


def escalates(se: Column, at: float = 0.5) -> Column:
    """Whether the first few samples disagree enough to draw more."""
    return se > at


def confidence(se: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - se)


def converged(df: DataFrame, by: str, order: str, value: str, patience: int, threshold: float) -> DataFrame:
    """``df`` with ``converged``: the last ``patience`` values all stay above the one before them less a share.

    A zero value before them counts as converged; too few rows don't."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(value, patience).over(w)
    least = F.min(value).over(w.rowsBetween(-(patience - 1), 0))
    hit = (before == 0) | (least >= before * (1 - threshold))
    return df.withColumn("converged", F.coalesce(hit, F.lit(False)))


def gray_zone(score: Column, keep: float, trash: float) -> Column:
    """keep, drop, or test by leaving out."""
    return F.when(score >= keep, "keep").when(score <= trash, "drop").otherwise("test")


def leave_one_out(chunks: DataFrame, query: str, chunk: str, se: str, se_without: str, most: int | None = None) -> DataFrame:
    """Chunks with ``kept``: dropped where the entropy without them is no larger.

    The first ``most`` chunks of a query are tested, the rest stay."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(chunk))
    tested = F.lit(True) if most is None else place <= most
    return chunks.withColumn("kept", ~(tested & (F.col(se_without) <= F.col(se))))


def two_phase(chunks: DataFrame, query: str, chunk: str, se: str, se_without: str, contradiction: str, at: float = 0.8, most: int | None = None) -> DataFrame:
    """Chunks with ``kept`` and ``phase``: those that contradict the first sample go; of the rest, leave-one-out."""
    against = F.coalesce(F.col(contradiction) >= at, F.lit(False))
    rows = chunks.withColumn("__against", against)
    place = F.row_number().over(Window.partitionBy(query, "__against").orderBy(chunk))
    tested = ~F.col("__against") & (F.lit(True) if most is None else place <= most)
    rows = rows.withColumn("__tested", tested)
    noise = F.col("__tested") & (F.col(se_without) <= F.col(se))
    phase = F.when(F.col("__against"), "contradiction").when(F.col("__tested"), "leave_one_out").otherwise("untested")
    return rows.withColumn("kept", ~(F.col("__against") | noise)).withColumn("phase", phase).drop("__against", "__tested")


def gray_zone_prune(chunks: DataFrame, query: str, chunk: str, score: str, se: str, se_without: str, keep: float, trash: float) -> DataFrame:
    """Chunks with ``zone``, ``kept`` and ``place``: by their score kept, dropped or, between, left out once to see; the place
    in the output has those kept by score first, each part in its old order, and is null for what is dropped."""
    rows = chunks.withColumn("zone", gray_zone(F.col(score), keep, trash))
    kept = (F.col("zone") == "keep") | ((F.col("zone") == "test") & (F.col(se_without) > F.col(se)))
    rows = rows.withColumn("kept", F.coalesce(kept, F.lit(False)))
    order = Window.partitionBy(query).orderBy(F.col("kept").desc(), (F.col("zone") != "keep"), chunk)
    return rows.withColumn("place", F.when(F.col("kept"), F.row_number().over(order)))


def prefix_prune(chunks: DataFrame, query: str, chunk: str, se: str, se_without: str, most: int | None = None) -> DataFrame:
    """Chunks with ``kept``, by leaving each of the first ``most`` out once."""
    return leave_one_out(chunks, query, chunk, se, se_without, most)


def pruner(strategy: str):
    """The pruning function of a strategy."""
    known = {"two_phase": two_phase, "gray_zone": gray_zone_prune, "prefix_caching": prefix_prune}
    if strategy not in known:
        raise ValueError(f"unknown pruning strategy {strategy!r}; known: {', '.join(sorted(known))}")
    return known[strategy]


def pruning_report(pruned: DataFrame, query: str) -> DataFrame:
    """(query, original, surviving) of a table with ``kept``."""
    return pruned.groupBy(query).agg(F.count("*").alias("original"), F.count_if("kept").alias("surviving"))


def triggers(logprobs: Column, pieces: Column, theta: float) -> Column:
    """Whether a piece that isn't blank is at or below a probability; never for a threshold of 0 or less."""
    if theta <= 0:
        return F.lit(False)
    both = F.arrays_zip(pieces.alias("p"), logprobs.alias("l"))
    return F.exists(both, lambda x: (stripped(x["p"]) != "") & (x["l"] <= F.log(F.lit(theta))))


def masked_query(pieces: Column, logprobs: Column, beta: float, fallback: Column) -> Column:
    """The pieces above a probability, others as spaces, collapsed, without an ``answer is`` before and quotes and full stops
    around; the question if nothing is left. A probability of 0 or less keeps every piece."""
    least = F.log(F.lit(beta)) if beta > 0 else F.lit(float("-inf"))
    # a token of probability 0 isn't above it either
    kept = F.zip_with(pieces, logprobs, lambda p, l: F.when(l > least, p).otherwise(F.lit(" ")))
    found = F.trim(F.regexp_replace(F.array_join(kept, ""), SPACE, " "))
    found = F.trim(F.regexp_replace(found, ANSWER_PREFIX, ""))
    found = F.regexp_replace(found, r"^[.\"']+|[.\"']+\z", "")
    return F.when(found != "", found).otherwise(fallback)


def low_token_query(tokens: Column, logprobs: Column, least: float = -1.0, most: int = 10) -> Column:
    """The first few tokens below a log-probability, as a search text; empty where there is none."""
    rows = F.arrays_zip(tokens.alias("token"), logprobs.alias("logprob"))
    low = F.transform(F.filter(rows, lambda r: r["logprob"] < least), lambda r: stripped(r["token"]))
    return F.array_join(F.slice(low, 1, most), " ")


def answerable(questions: DataFrame, kind: str = "question_type") -> DataFrame:
    """The questions that aren't null queries."""
    return questions.where(~F.col(kind).eqNullSafe(F.lit("null_query")))


def probability_trace(tokens: Column, pieces: Column, logprobs: Column) -> Column:
    """Each token as it is shown, its text and its probability."""
    rows = F.arrays_zip(tokens.alias("token"), pieces.alias("piece"), logprobs.alias("logprob"))
    return F.transform(
        rows, lambda r: F.struct(r["token"].alias("token"), r["piece"].alias("piece"), F.exp(r["logprob"]).alias("probability"))
    )


def min_probability(logprobs: Column) -> Column:
    """The least probability; null without tokens."""
    return F.exp(F.array_min(logprobs))


def call_costs(calls: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Calls with their cost: prices for a million tokens, 5 and 15 where the model isn't listed."""
    joined = calls.join(prices, calls[model] == prices["model"], "left")
    price = lambda c, d: F.coalesce(F.col(c), F.lit(float(d)))
    cost = (F.col(tokens_in) * price("price_in", 5) + F.col(tokens_out) * price("price_out", 15)) / F.lit(1e6)
    return joined.withColumn("cost", cost).drop("model", "price_in", "price_out")


def grid(spark, semantic: list[float], token: list[float]) -> DataFrame:
    """Every pair of thresholds."""
    values = lambda xs: F.explode(F.array(*map(F.lit, map(float, xs))))
    one = spark.range(1)
    return one.select(values(semantic).alias("tau_semantic")).select("tau_semantic", values(token).alias("tau_token"))


def perturbed(value: float, share: float = 0.2, steps: int = 5, floor: float = 0.01) -> list[float]:
    """Values evenly around one, not below a floor."""
    return [max(floor, value * (1 - share + 2 * share * i / (steps - 1))) for i in range(steps)]
