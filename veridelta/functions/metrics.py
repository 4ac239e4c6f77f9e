"""Answer metrics as Column expressions; golds are arrays, the best of them counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veridelta.functions.text import articles_first, bound, numbers, plain_tokens, punctuation_first, words


def exact_match(prediction: Column, golds: Column, form=articles_first) -> Column:
    """Whether a gold answer equals the prediction in normal form."""
    own = form(prediction)
    return F.coalesce(F.exists(golds, lambda g: form(g) == own), F.lit(False))


def containment(prediction: Column, golds: Column) -> Column:
    """Whether a gold answer's normal form lies within the prediction's; an empty one always does."""
    own = punctuation_first(prediction)
    return F.coalesce(F.exists(golds, lambda g: own.contains(punctuation_first(g))), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings: each element with its number among its equals is unique.

    Equals are numbered by runs of the sorted array, in one pass."""

    def numbered(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)))

        def each(starts: Column) -> Column:
            ends = F.slice(F.concat(F.slice(starts, F.lit(2), F.size(s)), F.array(F.size(s))), F.lit(1), F.size(starts))
            run = lambda at, end: F.transform(F.sequence(F.lit(0), end - at - 1), lambda j: F.concat(j.cast("string"), F.lit(" "), F.get(s, at)))
            return F.flatten(F.zip_with(starts, ends, run))

        return bound(each, starts=starts)

    return bound(lambda a, b: F.size(F.array_intersect(numbered(a), numbered(b))), a=F.array_sort(a), b=F.array_sort(b))


def f1_of(common: Column, n_prediction: Column, n_gold: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without anything in common."""
    return F.when(common > 0, F.lit(2.0) * common / (n_prediction + n_gold)).otherwise(F.lit(0.0))


def form_tokens(text: Column) -> Column:
    """The words of the articles-first form."""
    return words(articles_first(F.coalesce(text, F.lit(""))))


def token_f1(prediction: Column, golds: Column) -> Column:
    """Token F1 with the best gold, in the articles-first form; 0 for an empty prediction, empty golds are skipped."""

    def best(own: Column, others: Column) -> Column:
        scores = F.transform(others, lambda g: f1_of(overlap(own, g), F.size(own), F.size(g)))
        return F.coalesce(F.array_max(scores), F.lit(0.0))

    return bound(best, own=form_tokens(prediction), others=F.transform(golds, lambda g: form_tokens(g)))


def token_f1_single(prediction: Column, gold: Column) -> Column:
    """Token F1 with one gold; 1 if both are empty."""

    def single(a: Column, b: Column) -> Column:
        both_empty = (F.size(a) == 0) & (F.size(b) == 0)
        return F.when(both_empty, 1.0).otherwise(f1_of(overlap(a, b), F.size(a), F.size(b)))

    return bound(single, a=plain_tokens(prediction), b=plain_tokens(gold))


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: bits of one machine integer for each place of ``a``."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_subsequence(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two token arrays."""

    @F.pandas_udf("int")
    def lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_common_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")

    return lengths(left, right)


def rouge_l(prediction: Column, golds: Column) -> Column:
    """F1 of the longest common subsequence in the articles-first form, with the best gold; 0 for an empty prediction."""

    @F.pandas_udf("array<int>")
    def lengths(own: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([[] if gs is None else [_common_length(list(x), list(g)) for g in gs] for x, gs in zip(own, others)])

    own = form_tokens(prediction)
    others = F.transform(golds, lambda g: form_tokens(g))
    scores = lambda own, others, common: F.zip_with(
        others, common, lambda g, n: f1_of(n, F.size(own), F.size(g))
    )
    best = bound(
        lambda own, others, common: F.array_max(scores(own, others, common)), own=own, others=others, common=lengths(own, others)
    )
    return F.coalesce(best, F.lit(0.0))


def numeric_match(prediction: Column, golds: Column, tolerance: float = 1e-6) -> Column:
    """Whether a number of the prediction is a gold's, absolutely or relatively; without numbers, exact match."""
    own = numbers(prediction)
    close = lambda x, y: (F.abs(x - y) <= tolerance) | (F.abs(x - y) <= tolerance * F.abs(y))
    hit = F.exists(golds, lambda g: F.exists(numbers(g), lambda y: F.exists(own, lambda x: close(x, y))))
    return F.when(F.size(own) == 0, exact_match(prediction, golds)).otherwise(F.coalesce(hit, F.lit(False)))


def mean_or_zero(value: Column) -> Column:
    """Mean of a group, 0 if it is empty."""
    return F.coalesce(F.avg(value), F.lit(0.0))


METRICS = {"exact_match": exact_match, "token_f1": token_f1, "numeric": numeric_match, "rouge_l": rouge_l}


def suite(names: tuple[str, ...], prediction: Column, golds: Column) -> dict[str, Column]:
    """The named metrics of an answer, as numbers; an unknown name is an error."""
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return {n: METRICS[n](prediction, golds).cast("double") for n in names}
