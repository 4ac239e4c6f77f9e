"""Reports over finished runs: one row of figures, overall or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.metrics import mean_or_zero, token_f1_single
from veridelta.functions.metrics import exact_match as matches
from veridelta.functions.text import punctuation_first
from veridelta.operators.retrieval import evidence
from veridelta.operators.stats import aurocs

UNKNOWN = "legacy_or_unknown"


def _share(condition: Column) -> Column:
    return mean_or_zero(F.coalesce(condition, F.lit(False)).cast("double"))


def _told(runs: DataFrame) -> dict[str, Column]:
    """What a run doesn't record itself."""
    generation = F.coalesce(F.col("generation"), F.lit("")) if "generation" in runs.columns else F.lit("")
    signs = generation.contains("▁") | generation.contains("</s>")
    told = {"matched": F.coalesce("matched", "finished"), "clean": F.coalesce(F.col("clean"), ~signs)}
    if "retrieved" in runs.schema["steps"].dataType.elementType.names:
        told["initial_urls"] = F.coalesce(F.col("initial_urls"), F.get("steps", F.lit(0))["retrieved"])
    return told


def run_metrics(runs: DataFrame, by: str | None = None) -> DataFrame:
    """The figures of question-answering runs, overall, and with ``by`` for each of its values too (null: overall).

    ``runs``: run, answer, gold_answer, gold_urls, initial_urls, retrieved_urls, steps (structs of triggered and
    min_probability, in order), retrieval_calls, active_calls (null: counted from the steps), finished, forced,
    final_triggered, clean, exact, matched, stop_reason and end_reason. What a run doesn't record is told from the rest: ``matched``
    from finished, ``clean`` from the signs of a tokenizer in ``generation`` (if there is such a column), ``initial_urls`` from
    what the first step has ``retrieved`` (if steps have that). Recalls count where there is a gold url; histograms
    are maps from reason to number."""
    runs = runs.withColumns(_told(runs))
    found = evidence(runs, "run", "gold_urls", "initial_urls", "retrieved_urls")
    hits = lambda steps: F.size(F.filter(steps, lambda s: F.coalesce(s["triggered"], F.lit(False))))
    share = lambda steps: F.when(F.size(steps) > 0, hits(steps) / F.size(steps)).otherwise(0.0)
    steps = F.coalesce(F.col("steps"), F.array())
    later = F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0)))
    probabilities = F.filter(F.transform(steps, lambda s: s["min_probability"]), lambda p: p.isNotNull())
    rows = runs.join(found, "run").withColumns(
        {
            "__em": matches(F.col("answer"), F.array("gold_answer"), punctuation_first),
            "__f1": token_f1_single(F.col("answer"), F.col("gold_answer")),
            "__active": F.coalesce(F.col("active_calls").cast("double"), hits(steps).cast("double")),
            "__n": F.size(steps),
            "__rate": share(steps),
            "__later": share(later),
            "__p": F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p),
            "__np": F.size(probabilities),
            "__stop": F.coalesce("stop_reason", F.lit(UNKNOWN)),
            "__end": F.coalesce("end_reason", F.lit(UNKNOWN)),
        }
    )
    figures = [
        F.count("*").alias("examples"),
        _share(F.col("__em")).alias("answer_em"),
        mean_or_zero(F.col("__f1")).alias("answer_token_f1"),
        _share(F.col("finished")).alias("final_answer_rate"),
        _share(F.col("forced")).alias("forced_finalization_rate"),
        _share(F.col("final_triggered")).alias("finalization_active_retrieval_rate"),
        _share(F.col("clean")).alias("clean_output_rate"),
        _share(F.col("exact")).alias("all_token_alignments_exact_rate"),
        _share(F.col("matched")).alias("answer_extraction_pattern_match_rate"),
        mean_or_zero(F.col("__n")).alias("avg_generation_steps"),
        mean_or_zero(F.col("initial_recall")).alias("initial_evidence_recall"),
        mean_or_zero(F.col("recall")).alias("cumulative_evidence_recall"),
        mean_or_zero(F.col("precision")).alias("cumulative_evidence_precision"),
        mean_or_zero(F.col("all_found")).alias("all_evidence_success"),
        mean_or_zero(F.coalesce(F.col("retrieval_calls").cast("double"), F.lit(0.0))).alias("avg_retrieval_calls"),
        mean_or_zero(F.col("__active")).alias("avg_active_retrieval_calls"),
        _share(F.col("__active") > 0).alias("examples_with_active_retrieval_rate"),
        mean_or_zero(F.col("__rate")).alias("active_step_trigger_rate"),
        mean_or_zero(F.col("__later")).alias("additional_step_trigger_rate"),
        F.coalesce(F.try_divide(F.sum("__p"), F.sum("__np")), F.lit(0.0)).alias("mean_draft_min_probability"),
    ]
    key = F.coalesce(F.col(by), F.lit("unknown")) if by else F.lit(None).cast("string")
    rows = rows.withColumn("__by", key)
    out = rows.rollup("__by") if by else rows.groupBy("__by")
    out = out.agg(*figures)
    for name, column in (("reasoning_stop_reasons", "__stop"), ("termination_reasons", "__end")):
        out = out.join(histogram(rows, "__by", column, name, bool(by)), out["__by"].eqNullSafe(F.col("__key")), "left").drop("__key")
    return out.withColumnRenamed("__by", "question_type")


def histogram(rows: DataFrame, by: str, column: str, name: str, overall: bool) -> DataFrame:
    """(__key, name): a map from each value to its number; reasons are few. With ``overall``, for all rows too, under null."""
    counts = rows.groupBy(by, column).agg(F.count("*").alias("n"))
    if overall:
        counts = counts.unionByName(counts.groupBy(column).agg(F.sum("n").alias("n")).withColumn(by, F.lit(None).cast("string")))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column), F.col("n"))))
    return counts.groupBy(F.col(by).alias("__key")).agg(F.map_from_entries(pairs).alias(name))


def versions(runs: DataFrame, column: str) -> DataFrame:
    """(version, runs): the versions that runs were made by."""
    return runs.groupBy(F.coalesce(column, F.lit(UNKNOWN)).alias("version")).agg(F.count("*").alias("runs"))


def pipeline_stats(results: DataFrame, iterations: str, se: str, decision: str, by: list[str] = ()) -> DataFrame:
    """(by, examples, avg_iterations, avg_se_total, confident_stops_pct), rounded to 2, 4 and 1 places."""
    stop = (F.col(decision) == "CONFIDENT_STOP").cast("double")
    return results.groupBy(*by).agg(
        F.count("*").alias("examples"),
        F.round(mean_or_zero(F.col(iterations)), 2).alias("avg_iterations"),
        F.round(mean_or_zero(F.col(se)), 4).alias("avg_se_total"),
        F.round(mean_or_zero(stop) * 100, 1).alias("confident_stops_pct"),
    )


def _wrong_aurocs(rows: DataFrame, scores: dict[str, str], correct: str) -> DataFrame:
    """One row: how well each score tells wrong answers, by the score's name."""
    every = aurocs(rows.withColumn("__wrong", ~F.col(correct)), scores, "__wrong", [])
    return every.agg(*[F.max(F.when(F.col("score") == k, F.col("auroc"))).alias(k) for k in scores])


def _one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables of one row at most, side by side."""
    for other in others:
        first = first.join(F.broadcast(other), F.lit(True), "left")
    return first


def answer_summary(results: DataFrame, correct: str, semantic: str, token: str) -> DataFrame:
    """One row: examples, em, and how well each score tells wrong answers; the token score where it isn't null."""
    head = results.agg(F.count("*").alias("examples"), mean_or_zero(F.col(correct).cast("double")).alias("em"))
    return _one_row(head, _wrong_aurocs(results, {"auroc_semantic_incorrect": semantic, "auroc_token_incorrect": token}, correct))


POSTERIOR = ("anchor_risk", "total_entropy", "retrieval_mi", "generation_entropy")


def posterior_summary(scored: DataFrame, correct: str, context_sets: str, has_answer: str, baselines: dict[str, str]) -> DataFrame:
    """One row: examples, accuracy, the four posterior scores' AUROCs, the mean number of context sets and share of contexts
    that have the answer, and the AUROC of each baseline that no row lacks (else null)."""
    flat = F.explode(has_answer).alias("h")
    head = scored.agg(
        F.count("*").alias("examples"),
        F.avg(F.col(correct).cast("double")).alias("accuracy"),
        F.avg(context_sets).alias("mean_unique_context_sets"),
        *[F.bool_and(F.col(c).isNotNull()).alias(f"__{c}") for c in baselines],
    )
    contexts = scored.select(flat).agg(F.avg(F.col("h").cast("double")).alias("mean_context_hasanswer"))
    scores = {**{f"auroc_{c}_incorrect": c for c in POSTERIOR}, **{f"__a_{c}": c for c in baselines}}
    out = _one_row(head, contexts, _wrong_aurocs(scored, scores, correct))
    kept = [F.when(F.col(f"__{c}"), F.col(f"__a_{c}")).alias(name) for c, name in baselines.items()]
    return out.select("examples", "accuracy", *[f"auroc_{c}_incorrect" for c in POSTERIOR], "mean_unique_context_sets", "mean_context_hasanswer", *kept)


DECISIONS = ("PRUNE", "RETRIEVE", "STOP")


def modality_stats(steps: DataFrame, modality: str, decision: str, **scores: str) -> DataFrame:
    """(modality, num_examples, mean_<score> .., total_<decision>_decisions ..): the means rounded to 4 places, and a pivot of
    the decisions."""
    means = steps.groupBy(modality).agg(
        F.count("*").alias("num_examples"), *[F.round(mean_or_zero(F.col(c)), 4).alias(f"mean_{n}") for n, c in scores.items()]
    )
    turned = steps.groupBy(modality).pivot(decision, list(DECISIONS)).agg(F.count(F.lit(1)))
    totals = [F.coalesce(F.col(d), F.lit(0)).alias(f"total_{d.lower()}_decisions") for d in DECISIONS]
    turned = turned.select(F.col(modality).alias("__m"), *totals)
    return means.join(turned, F.col(modality).eqNullSafe(F.col("__m"))).drop("__m")
