"""Queries of the reports, over runs that Spark derives from the tables."""

from pyspark.sql import functions as F

from veridelta.functions import text
from veridelta.operators import control, reports
from veridelta.plans.registry import query, table
from veridelta.plans.texts import PUNCT, SPLIT, _f1, _overlap, _plain, form_two

#: A conversation as a run: its first two turns are the gold answer and the answer, its words stand for urls.
RUNS = f"""w AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), {SPLIT}), lambda w: w <> '') AS words FROM conversations),
  r AS (SELECT conv_id, first(text ORDER BY turn, text) AS gold, last(text ORDER BY turn, text) AS prediction,
    list_distinct(first(words ORDER BY turn, text)[1:4]) AS gold_urls, list_distinct(first(words ORDER BY turn, text)[2:3]) AS initial,
    list_distinct(flatten(list(words) FILTER (WHERE role = 'assistant'))) AS later, list(len(text) ORDER BY turn, text) AS sizes,
    max(len(text)) AS longest FROM w GROUP BY conv_id),
  e AS (SELECT *, coalesce(later, []) AS found, list_distinct(list_concat(coalesce(later, []), initial)) AS got FROM r),
  m AS (SELECT conv_id, CASE WHEN longest > 600 THEN 'long' WHEN longest > 300 THEN 'middle' END AS kind,
    {form_two('prediction')} = {form_two('gold')} AS em, {_plain('prediction')} AS p, {_plain('gold')} AS g, sizes,
    CASE WHEN len(gold_urls) > 0 THEN len(list_intersect(gold_urls, initial)) / CAST(len(gold_urls) AS DOUBLE) END AS ir,
    CASE WHEN len(gold_urls) > 0 THEN len(list_intersect(gold_urls, got)) / CAST(len(gold_urls) AS DOUBLE) END AS cr,
    CASE WHEN len(gold_urls) > 0 THEN CASE WHEN len(got) > 0 THEN len(list_intersect(gold_urls, got)) / CAST(len(got) AS DOUBLE) ELSE 0 END END AS cp,
    CASE WHEN len(gold_urls) > 0 THEN CAST(len(list_intersect(gold_urls, got)) = len(gold_urls) AS INT) END AS ae FROM e),
  x AS (SELECT *, list_transform(sizes, lambda s: s % 3 = 0) AS hit,
    list_filter(list_transform(sizes, lambda s: CASE WHEN s % 5 > 0 THEN 1.0 / (s % 5) END), lambda s: s IS NOT NULL) AS pr,
    {_overlap('p', 'g')} AS common FROM m),
  y AS (SELECT *, coalesce(kind, 'unknown') AS type, len(list_filter(hit, lambda h: h)) AS active, len(hit) AS n,
    len(list_filter(hit[2:], lambda h: h)) AS active_later FROM x)"""
FIGURES = f"""count(*) AS examples, round(avg(CAST(em AS INT)), 6) AS answer_em,
  round(avg(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 ELSE {_f1('common', 'p', 'g')} END), 6) AS answer_token_f1,
  round(avg(CAST(n % 2 = 0 AS INT)), 6) AS final_answer_rate, round(avg(CAST(n > 6 AS INT)), 6) AS forced_finalization_rate,
  0.0 AS finalization_active_retrieval_rate, round(avg(CAST(CASE WHEN conv_id % 4 = 1 THEN conv_id % 7 <> 1 ELSE active < 3 END AS INT)), 6) AS clean_output_rate,
  1.0 AS all_token_alignments_exact_rate, round(avg(CAST(CASE WHEN conv_id % 5 = 2 THEN n % 2 = 0 ELSE n % 3 = 0 END AS INT)), 6) AS answer_extraction_pattern_match_rate,
  round(avg(n), 6) AS avg_generation_steps, round(coalesce(avg(ir), 0), 6) AS initial_evidence_recall,
  round(coalesce(avg(cr), 0), 6) AS cumulative_evidence_recall, round(coalesce(avg(cp), 0), 6) AS cumulative_evidence_precision,
  round(coalesce(avg(ae), 0), 6) AS all_evidence_success, round(avg(n + 1), 6) AS avg_retrieval_calls,
  round(avg(active), 6) AS avg_active_retrieval_calls, round(avg(CAST(active > 0 AS INT)), 6) AS examples_with_active_retrieval_rate,
  round(avg(CASE WHEN n > 0 THEN active / CAST(n AS DOUBLE) ELSE 0 END), 6) AS active_step_trigger_rate,
  round(avg(CASE WHEN n > 1 THEN active_later / CAST(n - 1 AS DOUBLE) ELSE 0 END), 6) AS additional_step_trigger_rate,
  round(sum(coalesce(list_sum(pr), 0)) / sum(len(pr)), 6) AS mean_draft_min_probability,
  count(*) FILTER (WHERE n > 6) AS stopped_long, count(*) FILTER (WHERE n <= 6) AS stopped_unknown"""


def _runs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("words", text.words(F.col("text")))
    step = F.struct("turn", "text", "words", "role")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("t"))  # a run's few steps
    first, last = F.get("t", F.lit(0)), F.element_at("t", -1)
    own = F.filter("t", lambda s: s["role"] == "assistant")
    size = lambda s: F.length(s["text"])
    n = F.size("t")
    steps = F.transform(
        "t",
        lambda s: F.struct(
            (size(s) % 3 == 0).alias("triggered"), F.when(size(s) % 5 > 0, 1.0 / (size(s) % 5)).alias("min_probability")
        ),
    )
    longest = F.array_max(F.transform("t", size))
    active = F.size(F.filter("t", lambda s: size(s) % 3 == 0))
    return rows.select(
        F.col("conv_id").alias("run"),
        F.when(longest > 600, "long").when(longest > 300, "middle").alias("kind"),
        last["text"].alias("answer"),
        first["text"].alias("gold_answer"),
        F.slice(first["words"], 1, 4).alias("gold_urls"),
        F.slice(first["words"], 2, 2).alias("initial_urls"),
        F.flatten(F.transform(own, lambda s: s["words"])).alias("retrieved_urls"),
        steps.alias("steps"),
        (n + 1).alias("retrieval_calls"),
        F.lit(None).cast("int").alias("active_calls"),
        (n % 2 == 0).alias("finished"),
        (n > 6).alias("forced"),
        F.lit(None).cast("boolean").alias("final_triggered"),
        # some runs don't record whether they are clean or matched
        F.when(F.col("conv_id") % 4 != 1, active < 3).alias("clean"),
        F.when(F.col("conv_id") % 7 == 1, "an </s> sign").otherwise("none").alias("generation"),
        F.lit(True).alias("exact"),
        F.when(F.col("conv_id") % 5 != 2, n % 3 == 0).alias("matched"),
        F.when(n > 6, "long").alias("stop_reason"),
        F.lit("done").alias("end_reason"),
    )


@query(
    "run_metrics",
    f"""WITH {RUNS} SELECT NULL AS question_type, {FIGURES} FROM y UNION ALL SELECT type, {FIGURES} FROM y GROUP BY type""",
)
def run_metrics(spark, sf_dir):
    """The figures of all runs, overall and by kind, with the reasons why they stopped."""
    own = reports.run_metrics(_runs(spark, sf_dir), "kind")
    figures = [c for c, kind in own.dtypes if kind == "double"]
    reason = lambda k: F.coalesce(F.try_element_at("reasoning_stop_reasons", F.lit(k)), F.lit(0))
    return own.select(
        "question_type",
        "examples",
        *[F.round(c, 6).alias(c) for c in figures],
        reason("long").alias("stopped_long"),
        reason(reports.UNKNOWN).alias("stopped_unknown"),
    )


@query(
    "evidence_recall",
    f"""WITH {RUNS} SELECT conv_id AS run, round(ir, 6) AS initial_recall, round(cr, 6) AS recall, round(cp, 6) AS "precision",
      CAST(ae AS DOUBLE) AS all_found FROM y""",
)
def evidence_recall(spark, sf_dir):
    """How much of each run's evidence was there at first and in the end."""
    own = reports.evidence(_runs(spark, sf_dir), "run", "gold_urls", "initial_urls", "retrieved_urls")
    return own.select("run", *[F.round(c, 6).alias(c) for c in ("initial_recall", "recall", "precision")], "all_found")


DECIDED = """d AS (SELECT event_id, user_id, event_type, value, CASE WHEN value > 20 THEN 'RETRIEVE' WHEN value > 10 THEN 'PRUNE'
  WHEN value > 5 THEN 'STOP' ELSE 'CONFIDENT_STOP' END AS decision FROM events)"""


def _decided(spark, sf_dir):
    v = F.col("value")
    decision = F.when(v > 20, "RETRIEVE").when(v > 10, "PRUNE").when(v > 5, "STOP").otherwise("CONFIDENT_STOP")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", decision.alias("decision"))


@query(
    "pipeline_stats",
    f"""WITH {DECIDED} SELECT event_type, count(*) AS examples, round(avg(user_id % 5), 2) AS avg_iterations,
      round(avg(round(value, 2)), 4) AS avg_se_total, round(avg(CASE WHEN decision = 'CONFIDENT_STOP' THEN 1.0 ELSE 0 END) * 100, 1) AS confident_stops_pct
    FROM d GROUP BY event_type""",
)
def pipeline_stats(spark, sf_dir):
    """Iterations, entropy and confident stops of each kind of event."""
    rows = _decided(spark, sf_dir).withColumns({"iterations": F.col("user_id") % 5, "se": F.round("value", 2)})
    return reports.pipeline_stats(rows, "iterations", "se", "decision", ["event_type"])


@query(
    "modality_stats",
    f"""WITH {DECIDED} SELECT event_type, count(*) AS num_examples, round(avg(value), 4) AS mean_se_total,
      round(avg(value * (event_id % 2)), 4) AS mean_se_aleatoric, count(*) FILTER (WHERE decision = 'PRUNE') AS total_prune_decisions,
      count(*) FILTER (WHERE decision = 'RETRIEVE') AS total_retrieve_decisions, count(*) FILTER (WHERE decision = 'STOP') AS total_stop_decisions
    FROM d GROUP BY event_type""",
)
def modality_stats(spark, sf_dir):
    """Mean scores of each kind of event, and its decisions in columns."""
    rows = _decided(spark, sf_dir).withColumn("part", F.col("value") * (F.col("event_id") % 2))
    return reports.modality_stats(rows, "event_type", "decision", se_total="value", se_aleatoric="part")


def _wrong(column: str, name: str) -> str:
    """The AUROC of a column over rows (s, correct), wrong answers being positive."""
    return f"""(SELECT (sum(r) FILTER (WHERE NOT correct) - count(*) FILTER (WHERE NOT correct) * (count(*) FILTER (WHERE NOT correct) + 1) / 2.0)
      / nullif(count(*) FILTER (WHERE NOT correct) * count(*) FILTER (WHERE correct), 0) FROM (SELECT correct, rank() OVER (ORDER BY {column})
      + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS r FROM z WHERE {column} IS NOT NULL)) AS {name}"""


JUDGED = """z AS (SELECT d.doc_id, l.quality = 1 AS correct, round(d.n_chars / 997.0, 4) AS a, CASE WHEN d.doc_id % 3 > 0 THEN d.n_chars % 101 END AS b,
  d.n_chars % 89 AS c, d.doc_id % 17 AS e, d.n_chars % 7 AS f FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _judged(spark, sf_dir):
    docs, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id"), F.col("doc_id") == F.col("l_id"))
    return rows.select(
        "doc_id", (F.col("quality") == 1).alias("correct"), F.round(n / 997.0, 4).alias("a"),
        F.when(F.col("doc_id") % 3 > 0, n % 101).alias("b"), (n % 89).alias("c"), (F.col("doc_id") % 17).alias("e"), (n % 7).alias("f"),
    )


@query(
    "answer_summary",
    f"""WITH {JUDGED} SELECT count(*) AS examples, round(avg(CAST(correct AS INT)), 6) AS em,
      round({_wrong('a', 'x').removesuffix(' AS x')}, 6) AS auroc_semantic_incorrect,
      round({_wrong('b', 'x').removesuffix(' AS x')}, 6) AS auroc_token_incorrect FROM z""",
)
def answer_summary(spark, sf_dir):
    """How many answers are right, and how well two scores tell the wrong ones; one is null in some rows."""
    own = reports.answer_summary(_judged(spark, sf_dir), "correct", "a", "b")
    return own.select("examples", *[F.round(c, 6).alias(c) for c in ("em", "auroc_semantic_incorrect", "auroc_token_incorrect")])


@query(
    "posterior_summary",
    f"""WITH {JUDGED} SELECT count(*) AS examples, round(avg(CAST(correct AS INT)), 6) AS accuracy,
      {', '.join(f"round({_wrong(c, 'x').removesuffix(' AS x')}, 6) AS auroc_{n}_incorrect" for c, n in zip('aecf', reports.POSTERIOR))},
      round(avg(f), 6) AS mean_unique_context_sets, round(sum(e % 2 + c % 2) / (2.0 * count(*)), 6) AS mean_context_hasanswer,
      round({_wrong('c', 'x').removesuffix(' AS x')}, 6) AS auroc_ppl_incorrect, CAST(NULL AS DOUBLE) AS auroc_token_incorrect FROM z""",
)
def posterior_summary(spark, sf_dir):
    """The four posterior scores' ranking of wrong answers, and of baselines that no row lacks."""
    rows = _judged(spark, sf_dir)
    rows = rows.withColumns({n: F.col(c) for c, n in zip("aecf", reports.POSTERIOR)})
    rows = rows.withColumn("has", F.array(F.col("e") % 2 == 1, F.col("c") % 2 == 1))
    own = reports.posterior_summary(rows, "correct", "f", "has", {"c": "auroc_ppl_incorrect", "b": "auroc_token_incorrect"})
    return own.select("examples", *[F.round(c, 6).alias(c) for c in own.columns if c != "examples"])


@query(
    "two_phase_pruning",
    """WITH c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, value > 22 ORDER BY event_id) AS n FROM events)
    SELECT user_id, event_id, NOT (value > 22 OR (n <= 6 AND value % 7 <= 3)) AS kept,
      CASE WHEN value > 22 THEN 'contradiction' WHEN n <= 6 THEN 'leave_one_out' ELSE 'untested' END AS phase FROM c""",
)
def two_phase_pruning(spark, sf_dir):
    """Contradictions dropped, then leave-one-out over each user's first events."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value").withColumns(
        {"se": F.lit(3.0), "without": F.col("value") % 7, "against": (F.col("value") > 22).cast("double")}
    )
    return control.two_phase(rows, "user_id", "event_id", "se", "without", "against", 0.8, 6).select("user_id", "event_id", "kept", "phase")


@query(
    "gray_zone_pruning",
    """WITH z AS (SELECT user_id, event_id, value, CASE WHEN value >= 15 THEN 'keep' WHEN value <= 4 THEN 'drop' ELSE 'test' END AS zone FROM events),
    k AS (SELECT *, zone = 'keep' OR (zone = 'test' AND value % 7 > 3) AS kept FROM z)
    SELECT user_id, event_id, zone, kept, CAST(CASE WHEN kept THEN row_number() OVER (PARTITION BY user_id
      ORDER BY kept DESC, zone <> 'keep', event_id) END AS INTEGER) AS place FROM k""",
)
def gray_zone_pruning(spark, sf_dir):
    """Events kept or dropped by their value, those between by leaving them out."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value").withColumns(
        {"se": F.lit(3.0), "without": F.col("value") % 7}
    )
    own = control.gray_zone_prune(rows, "user_id", "event_id", "value", "se", "without", 15, 4)
    return own.select("user_id", "event_id", "zone", "kept", "place")
