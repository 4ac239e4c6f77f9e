"""Entropies and token uncertainties of sampled answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.text import is_key_token, stable_seed, stripped
from veridelta.operators.stats import running_totals

#: Log-probabilities are summed together within spans of this size.
SPAN = 256.0


def entropy(df: DataFrame, by: list[str], kind: str, log=F.log2, name: str = "entropy") -> DataFrame:
    """Entropy of ``kind``'s frequencies within each group; null kinds don't count."""
    counts = df.where(F.col(kind).isNotNull()).groupBy(*by, kind).agg(F.count("*").alias("__n"))
    # the group's total rides along as a second aggregate: sum n log n and sum n give the entropy in one more step
    n = F.col("__n").cast("double")
    return counts.groupBy(*by).agg(
        (log(F.sum(n)) - F.sum(n * log(n)) / F.sum(n)).alias(name),
        F.sum("__n").alias("n_samples"),
        F.count("*").alias("n_kinds"),
    )


def normalised(entropy_bits: Column, n: Column) -> Column:
    """Entropy over its largest possible value; 0 for a single sample."""
    return F.when(n > 1, entropy_bits / F.log2(n)).otherwise(F.lit(0.0))


def token_uncertainty(
    tokens: DataFrame, query: str, sample: str, logprob: str, legacy: bool = False, token: str | None = None, questions: DataFrame | None = None
) -> DataFrame:
    """Mean over samples of the mean bits of their key tokens above -100; ``legacy`` divides by log2(e) instead of ln 2.

    With ``token``, a column of tokens, only those that carry content count. A sample without any is left out; a question of
    ``questions`` without any has 0."""
    unit = math.log2(math.e) if legacy else math.log(2)
    kept = tokens.where(F.col(logprob) > -100)
    if token is not None:
        kept = kept.where(is_key_token(F.col(token)))
    by_sample = kept.groupBy(query, sample).agg(F.avg(-F.col(logprob) / unit).alias("__u"))
    out = by_sample.groupBy(query).agg(F.avg("__u").alias("u_token"))
    if questions is None:
        return out
    all_ = questions.select(query).distinct().join(out, query, "left")
    return all_.select(query, F.coalesce("u_token", F.lit(0.0)).alias("u_token"))


def profile(samples: DataFrame, tokens: DataFrame, query: str, sample: str, concept: str, logprob: str, token: str | None = None) -> DataFrame:
    """(query, se, u_token, n_samples, n_kinds, distribution): both signals of each question, and its concepts' shares."""
    h = entropy(samples, [query], concept).withColumnRenamed("entropy", "se")
    shares = samples.where(F.col(concept).isNotNull()).groupBy(query, concept).agg(F.count("*").alias("__n"))
    # a row for each concept: as many as a question has samples at most
    shares = shares.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(concept, "__n"))).alias("__s"), F.sum("__n").alias("__t"))
    share = F.transform("__s", lambda x: F.struct(x[concept].alias(concept), (x["__n"] / F.col("__t")).alias("probability")))
    shares = shares.select(query, share.alias("distribution"))
    u = token_uncertainty(tokens, query, sample, logprob, token=token, questions=samples)
    return h.join(u, query).join(shares, query)


def regular_entropy(tokens: DataFrame, query: str, response: str, logprob: str) -> DataFrame:
    """(query, regular_entropy): the mean over responses of the negative mean of their log-probabilities."""
    own = tokens.groupBy(query, response).agg(F.avg(logprob).alias("__l"))
    return own.groupBy(query).agg((-F.avg("__l")).alias("regular_entropy"))


def response_entropies(responses: DataFrame, query: str, response: str, logprobs: str, kind: str) -> DataFrame:
    """(query, regular_entropy, semantic_entropy, cluster_assignment_entropy) of responses with their classes.

    A question with fewer than two responses, or a response without log-probabilities, is an error."""
    if not responses.where(F.coalesce(F.size(logprobs), F.lit(0)) <= 0).isEmpty():
        raise ValueError("every response needs a log-probability")
    if not responses.groupBy(query).agg(F.count("*").alias("n")).where("n < 2").isEmpty():
        raise ValueError("every question needs two responses")
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs)
    own = responses.select(query, response, kind, mean.alias("__l"))
    regular = own.groupBy(query).agg((-F.avg("__l")).alias("regular_entropy"))
    semantic = weighted_entropy(cluster_mass(own, query, kind, "__l"), query)
    assigned = entropy(own, [query], kind, F.log, "cluster_assignment_entropy").select(query, "cluster_assignment_entropy")
    return regular.join(semantic, query).join(assigned, query)


def affirmative_logprob(top: Column) -> Column:
    """The log-probability of the token A in a map of tokens, the one with a space before it first, else the least of those
    that are A but for white space; an error if there is none."""
    bare = lambda t: stripped(F.replace(t, F.lit("▁"), F.lit(" ")))
    found = F.map_filter(top, lambda t, _: bare(t) == "A")
    spaced = F.map_filter(found, lambda t, _: t.isin(" A", "▁A"))
    first = lambda m: F.get(F.map_values(m), F.lit(0))
    return F.coalesce(first(spaced), first(found), F.raise_error(F.lit("the token A isn't among the tokens")).cast("double"))


def few_shots(train: DataFrame, order: str, answers: str, share: float, count: int, seed: int) -> DataFrame:
    """``count`` answerable rows of the first ``share`` of a table in its order, by their stable seeds; an error if there are fewer.

    ``order`` is a number. The same rows come whatever the table's partitioning."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    n = int(train.count() * share)
    # the prefix by running counts over ranges of the order, so that no task takes the whole table
    places = train.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("n"))
    within = running_totals(places, [], order, ["n"]).where(F.col("upto_n") <= n).select(F.col(order).alias("__o"))
    some = train.join(within, F.col(order) == F.col("__o"), "left_semi").where(F.size(answers) > 0)
    picked = some.orderBy(stable_seed(seed, F.col(order)), order).limit(count)
    if picked.count() < count:
        raise ValueError("there are too few answerable rows")
    return picked


def perplexity(tokens: DataFrame, by: list[str], logprob: str) -> DataFrame:
    """Mean negative log-likelihood and its exponential."""
    own = tokens.groupBy(*by).agg((-F.avg(logprob)).alias("nll"))
    return own.withColumn("ppl", F.exp("nll"))


def p_true_uncertainty(logprob: Column) -> Column:
    """One minus the probability of the affirmative token, not renormalised."""
    return F.lit(1.0) - F.exp(logprob)


def cluster_mass(responses: DataFrame, query: str, cluster: str, loglik: str) -> DataFrame:
    """Normalised log mass of each cluster: log-sum-exp of its responses over that of all."""
    l = F.col(loglik)  # noqa: E741
    step = F.when(l > float("-inf"), F.floor(l / SPAN))
    # sums within a span can't overflow, so no response has to know its question's largest: a few rows for each cluster are left
    parts = responses.withColumn("__b", step).groupBy(query, cluster, "__b").agg(F.sum(F.exp(l - F.col("__b") * SPAN)).alias("__s"))
    top = F.max("__b").over(Window.partitionBy(query))
    parts = parts.withColumn("__s", F.col("__s") * F.exp((F.col("__b") - top) * SPAN))
    parts = parts.groupBy(query, cluster).agg(F.sum("__s").alias("__s"))
    total = F.sum("__s").over(Window.partitionBy(query))
    return parts.withColumn("log_mass", F.log(F.col("__s") / total)).drop("__s")


def weighted_entropy(masses: DataFrame, query: str) -> DataFrame:
    """Probability-weighted semantic entropy of cluster masses, in nats."""
    l = F.col("log_mass")  # noqa: E741
    return masses.groupBy(query).agg((-F.sum(F.exp(l) * l)).alias("semantic_entropy"))


def posterior_scores(draws: DataFrame, question: str, context: str, kind: str, anchor: Column | None = None) -> DataFrame:
    """Total and mean within-context entropy in nats, their non-negative difference and, with ``anchor``, its mass."""
    total = entropy(draws, [question], kind, F.log, "total_entropy")
    within = entropy(draws, [question, context], kind, F.log, "__h")
    within = within.groupBy(question).agg(F.avg("__h").alias("generation_entropy"))
    out = total.select(question, "total_entropy", F.col("n_kinds").alias("n_concepts")).join(within, question)
    out = out.withColumn("retrieval_mi", F.greatest(F.lit(0.0), F.col("total_entropy") - F.col("generation_entropy")))
    if anchor is not None:
        mass = draws.groupBy(question).agg(F.avg(anchor.cast("double")).alias("anchor_mass"))
        out = out.join(mass, question).withColumn("anchor_risk", 1 - F.col("anchor_mass"))
    return out
