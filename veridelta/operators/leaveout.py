"""Contexts with one chunk left out, evaluated for all questions in one call, and the pruners that rest on them.

``evaluate(tests, contexts)`` is given: of the tests (query, left_out) and their contexts (query, left_out, and the columns of
the chunks that stay) it makes (query, left_out, se_without). A context can be empty: its test is in ``tests`` alone. A test
that has no value keeps its chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.operators import control
from veridelta.session import written

Evaluate = Callable[[DataFrame, DataFrame], DataFrame]


def first_chunks(chunks: DataFrame, query: str, chunk: str, most: int | None) -> DataFrame:
    """(query, left_out): the chunks that are tested, the first ``most`` of a question. The limit holds within the tasks
    already, so a question with very many chunks isn't brought together."""
    rows = chunks.select(query, F.col(chunk).alias("left_out"))
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy(query).orderBy("left_out"))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def contexts_without(candidates: DataFrame, tests: DataFrame, query: str, chunk: str) -> DataFrame:
    """For each test the candidates of its question but the one left out: (query, left_out, .., chunk).

    A question has a bounded number of tests; both sides are dealt out for the join alone, so a question with very many
    chunks can be split."""
    dealt = [df.withColumn("__dealt", F.xxhash64(query)) for df in (candidates, tests)]
    both = dealt[0].join(dealt[1], [query, "__dealt"]).drop("__dealt")
    return both.where(F.col(chunk) != F.col("left_out"))


def _valued(chunks, candidates, tested, query, chunk, evaluate: Evaluate, most) -> DataFrame:
    """The chunks with ``se_without``, by one call of ``evaluate``."""
    tests = written(first_chunks(tested, query, chunk, most), "tests")
    found = evaluate(tests, contexts_without(candidates, tests, query, chunk))
    values = written(found.select(query, F.col("left_out").alias(chunk), "se_without"), "left-out")
    return chunks.join(values, [query, chunk], "left")


def two_phase(
    chunks: DataFrame, query: str, chunk: str, se: str, evaluate: Evaluate, contradiction: str, at: float = 0.8, most: int | None = 10
) -> DataFrame:
    """``chunks`` with ``se_without``, ``kept`` and ``phase``: those that contradict the first sample go; the first ``most`` of
    the rest are left out, each from the rest alone."""
    rest = chunks.where(~F.coalesce(F.col(contradiction) >= at, F.lit(False)))
    rows = _valued(chunks, rest, rest, query, chunk, evaluate, most)
    return control.two_phase(rows, query, chunk, se, "se_without", contradiction, at, most)


def gray_zone(
    chunks: DataFrame, query: str, chunk: str, se: str, evaluate: Evaluate, score: str, keep: float, trash: float
) -> DataFrame:
    """``chunks`` with ``se_without``, ``zone``, ``kept`` and ``place``: those between the thresholds are left out, each from the
    kept and the other tested ones."""
    zone = control.gray_zone(F.col(score), keep, trash)
    rows = _valued(chunks, chunks.where(zone != "drop"), chunks.where(zone == "test"), query, chunk, evaluate, None)
    return control.gray_zone_prune(rows, query, chunk, score, se, "se_without", keep, trash)


def prefix_caching(
    chunks: DataFrame, query: str, chunk: str, se: str, evaluate: Evaluate, most: int | None = 10
) -> DataFrame:
    """``chunks`` with ``se_without`` and ``kept``: each of the first ``most`` is left out once."""
    rows = _valued(chunks, chunks, chunks, query, chunk, evaluate, most)
    return control.prefix_prune(rows, query, chunk, se, "se_without", most)
