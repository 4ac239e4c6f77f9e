"""Uncertainties, statistics, control, clustering, retrieval, reports, records and settings on stated values."""

import math
import random
import time
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridelta.operators import cluster, control, retrieval, stats, uncertainty
from veridelta import settings
from veridelta.operators import reports
from veridelta.plans import flows
from veridelta.sources import records


def near(a, b):
    return abs(a - b) < 1e-9


@pytest.mark.parametrize("kinds, want", [("a", 0), ("ab", 1), ("abc", math.log2(3)), ("aaaab", 0.7219280948873623)])
def test_entropy(spark, kinds, want):
    rows = spark.createDataFrame([(1, k) for k in kinds], "q long, k string")
    assert near(uncertainty.entropy(rows, ["q"], "k").first().entropy, want)


def test_token_uncertainty(spark):
    rows = [(1, 0, -1.0), (1, 0, -3.0), (1, 1, -4.0), (1, 1, -500.0)]
    rows = spark.createDataFrame(rows, "q long, s long, lp double")
    assert near(uncertainty.token_uncertainty(rows, "q", "s", "lp").first().u_token, 3 / math.log(2))
    assert near(uncertainty.token_uncertainty(rows, "q", "s", "lp", legacy=True).first().u_token, 3 / math.log2(math.e))


def test_posterior_scores_add_up(spark):
    ids = [2, 0, 0, 2, 0, 1, 1, 0, 2, 0]
    rows = spark.createDataFrame([(1, i // 2, k) for i, k in enumerate(ids)], "q long, c long, k long")
    got = uncertainty.posterior_scores(rows, "q", "c", "k", F.col("k") == 0).first()
    assert near(got.anchor_mass, 0.5) and got.retrieval_mi > 0 and near(got.total_entropy, got.generation_entropy + got.retrieval_mi)


def test_auroc(spark):
    rows = spark.createDataFrame([(1, -2.0, False), (1, 3.5, True), (1, 3.25, True), (2, 8.0, True)], "g long, s double, bad boolean")
    got = {r.g: r.auroc for r in stats.auroc(rows, "s", "bad", ["g"]).collect()}
    assert got == {1: 1.0, 2: None}


def test_midranks_of_frequent_values_and_repeated_rows(spark):
    draw = random.Random(5)
    rows = [(draw.choice("xy"), None if i % 50 == 0 else float(draw.choice([0, 0, 0, 1, i])), i // 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, i int")
    got = Counter((r.g, r.s, r.i, r.midrank) for r in stats.midranks(df, "s", ["g"]).collect())
    want = Counter()
    for g in "xy":
        values = sorted(s for h, s, _ in rows if h == g and s is not None)
        rank = {v: (bisect_left(values, v) + 1 + bisect_right(values, v)) / 2 for v in set(values)}
        want += Counter((g, s, i, rank[s]) for h, s, i in rows if h == g and s is not None)
    assert got == want
    assert stats.midranks(df.limit(0), "s", ["g"]).count() == 0


def test_aurocs_of_many_scores_at_once(spark):
    draw = random.Random(9)
    rows = [(draw.random() < 0.3, draw.choice([None, 1.0, 2.0, draw.random()]), float(draw.randrange(5)), None) for _ in range(400)]
    df = spark.createDataFrame(rows, "y boolean, a double, b double, c double")
    got = {r.score: (r.auroc, r.n_positive, r.n_negative) for r in stats.aurocs(df, {"first": "a", "second": "b", "none": "c"}, "y", []).collect()}
    for name, at in (("first", 1), ("second", 2)):
        p, n = ([r[at] for r in rows if r[0] == y and r[at] is not None] for y in (True, False))
        wins = sum((x > z) + (x == z) / 2 for x in p for z in n)
        assert near(got[name][0], wins / (len(p) * len(n))) and got[name][1:] == (len(p), len(n))
    assert set(got) == {"first", "second"}
    assert stats.aurocs(df.limit(0), {"first": "a"}, "y", []).count() == 0


def test_places_among_bounds(spark):
    for m in (0, 1, 2, 3, 7, 8):
        bounds = F.array(*[F.lit(float(b)) for b in range(m)]) if m else F.array().cast("array<double>")
        got = spark.range(-1, 20).select((F.col("id") / 2).alias("v")).select("v", stats._place(bounds, F.col("v"), m + 1).alias("n"))
        assert all(r.n == sum(b < r.v for b in range(m)) for r in got.collect())


def test_auroc_with_ties(spark):
    rows = spark.createDataFrame([(1, 1.0, True), (1, 1.0, False), (1, 2.0, True), (1, 0.0, False)], "g long, s double, bad boolean")
    assert near(stats.auroc(rows, "s", "bad", ["g"]).first().auroc, 0.875)


def test_delong_of_one_class_and_of_equal_scores(spark):
    rows = spark.createDataFrame([(1.0, 2.0, True)], "a double, b double, bad boolean")
    assert stats.delong(rows, "a", "b", "bad").first().z is None
    rows = spark.createDataFrame([(float(i), float(i), i % 2 == 0) for i in range(8)], "a double, b double, bad boolean")
    got = stats.delong(rows, "a", "b", "bad").first()
    assert got.difference == 0 and got.p_value is None


@pytest.mark.parametrize("right, low, high", [((0.95, 0.02), -1, 0.1), ((0.7, 0.7), 0.25, 0.45)])
def test_calibration(spark, right, low, high):
    rows = [(right[0], 1.0)] * 30 + [(right[1], 0.0)] * 45
    bins = stats.calibration_bins(spark.createDataFrame(rows, "c double, y double"), "c", "y", 5)
    assert bins.count() == 5
    assert low < stats.calibration_error(bins).first().ece < high


def test_delong_against_plain_placements(spark):
    draw = np.random.default_rng(3)
    y = draw.random(90) < 0.4
    a, b = np.round(y + draw.normal(size=90), 1), np.round(y * 0.3 + draw.normal(size=90), 1)
    rows = spark.createDataFrame([(float(p), float(q), bool(t)) for p, q, t in zip(a, b, y)], "a double, b double, bad boolean").repartition(4)
    got = stats.delong(rows, "a", "b", "bad").first()
    place = lambda s: (s[y][:, None] > s[~y]) + 0.5 * (s[y][:, None] == s[~y])
    pa, pb = place(a), place(b)
    gap = pa - pb
    var = gap.mean(1).var(ddof=1) / y.sum() + gap.mean(0).var(ddof=1) / (~y).sum()
    z = gap.mean() / math.sqrt(var)
    assert near(got.auc_a, pa.mean()) and near(got.auc_b, pb.mean()) and near(got.z, z)
    assert near(got.p_value, math.erfc(abs(z) / math.sqrt(2)))


@pytest.mark.parametrize("z", [0.0, 0.3, 1.96, 2.99, 3.0, 5.5, 9.0])
def test_two_sided(spark, z):
    got = spark.range(1).select(stats.two_sided(F.lit(z)).alias("p")).first().p
    assert got == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-7, abs=1e-15)


def test_running_totals_over_ranges(spark):
    rows = [(i % 3, float(i * 7 % 101), i % 5) for i in range(300)]
    counts = spark.createDataFrame(rows, "g long, v double, n long").groupBy("g", "v").agg(F.sum("n").alias("n")).repartition(7)
    got = stats.running_totals(counts, ["g"], "v", ["n"]).collect()
    want = {(g, v): sum(n for h, w, n in rows if h == g and w <= v) for g, v, _ in rows}
    assert {(r.g, r.v): r.upto_n for r in got} == want and len(got) == len(want)


def test_routing(spark):
    row = spark.range(1).select(
        control.route(F.lit(2.0), F.lit(9.0), F.lit(1.0), F.lit(1.0)).alias("a"),
        control.route(F.lit(0.5), F.lit(9.0), F.lit(1.0), F.lit(1.0)).alias("b"),
        control.route(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("c"),
        control.adaptive_threshold(F.lit(0.1), 0.8, 0.2).alias("d"),
        control.gray_zone(F.lit(0.5), 0.8, 0.2).alias("e"),
    ).first()
    assert tuple(row) == ("RETRIEVE", "PRUNE", "STOP", 0.2, "test")
    assert control.perturbed(1.0) == pytest.approx([0.8, 0.9, 1.0, 1.1, 1.2])


def test_trigger_and_mask(spark):
    pieces = F.array(F.lit("Ships"), F.lit(" sailed"), F.lit(" north"))
    lps = F.array(*[F.lit(math.log(p)) for p in (0.7, 0.3, 0.6)])
    shown = F.array(F.lit("The answer is"), F.lit(' "north'), F.lit('".'))
    row = spark.range(1).select(
        control.triggers(lps, pieces, 0.5).alias("t"),
        control.triggers(lps, pieces, 0.0).alias("never"),
        control.masked_query(pieces, lps, 0.5, F.lit("q")).alias("m"),
        control.masked_query(pieces, lps, 0.9, F.lit("q")).alias("f"),
        control.masked_query(pieces, lps, 0.0, F.lit("q")).alias("all"),
        control.masked_query(shown, lps, 0.1, F.lit("q")).alias("bare"),
        F.round(control.min_probability(lps), 9).alias("least"),
        F.round(control.probability_trace(pieces, pieces, lps)[1]["probability"], 9).alias("second"),
    ).first()
    assert tuple(row) == (True, False, "Ships north", "q", "Ships sailed north", "north", 0.3, 0.3)


def test_rationale_and_thresholds(spark):
    row = spark.range(1).select(control.rationale(F.lit(0.2), F.lit(0.9), F.lit(0.5), F.lit(0.5)).alias("r")).first().r
    assert row.decision == "PRUNE" and "0.9000" in row.reason and row.se_semantic == 0.2
    rows = spark.createDataFrame([(1, 0, 2.0, 4.0), (1, 1, 0.5, 0.5)], "q long, t long, se double, u double")
    got = control.thresholds(rows, "q", "t", (0.5, 0.5), (0.1, 3.0)).orderBy("t").collect()
    assert [(r.tau_semantic, r.tau_token, r.calibrated) for r in got] == [(1.0, 3.0, False), (1.0, 3.0, True)]


def test_samples_to_draw(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.1)], "q long, se double")
    assert control.samples_to_draw(rows, 4, 2, 6, False).count() == 8
    assert control.samples_to_draw(rows, 4, 2, 6, True).count() == 4
    more = control.samples_to_draw(rows, 4, 2, 6, True, "se").collect()
    assert [(r.q, r.sample) for r in more] == [(1, 2), (1, 3), (1, 4), (1, 5)]
    with pytest.raises(ValueError):
        control.samples_to_draw(rows, 4, 6, 6, True)


CHUNKS = [(1, 0, 0.9, 1.0, 0.9), (1, 1, 0.1, 0.2, 0.5), (1, 2, 0.2, 0.9, 0.3), (1, 3, 0.0, 0.1, 0.1), (1, 4, None, 0.3, 0.5)]


def test_pruners(spark):
    rows = spark.createDataFrame(CHUNKS, "q long, c long, against double, without double, score double").withColumn("se", F.lit(0.5))
    got = control.pruner("two_phase")(rows, "q", "c", "se", "without", "against", 0.8, 3).orderBy("c").collect()
    assert [r.phase for r in got] == ["contradiction", "leave_one_out", "leave_one_out", "leave_one_out", "untested"]
    assert [r.kept for r in got] == [False, False, True, False, True]
    got = control.pruner("gray_zone")(rows, "q", "c", "score", "se", "without", 0.9, 0.1).orderBy("c").collect()
    assert [r.zone for r in got] == ["keep", "test", "test", "drop", "test"] and [r.place for r in got] == [1, None, 2, None, None]
    got = control.pruner("prefix_caching")(rows, "q", "c", "se", "without", 2).orderBy("c").collect()
    assert [r.kept for r in got] == [True, False, True, True, True]
    assert control.pruning_report(control.prefix_prune(rows, "q", "c", "se", "without", 2), "q").first().surviving == 4
    with pytest.raises(ValueError):
        control.pruner("other")


def test_concepts(spark):
    samples = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)], "q long, s long")
    scores = [(1, 3, 1, 0.9), (1, 1, 3, 0.9), (1, 1, 2, 0.9), (1, 2, 1, 0.6), (1, 0, 2, 0.2), (2, 0, 1, 0.9)]
    edges = cluster.both_ways(spark.createDataFrame(scores, "q long, i long, j long, entailment double"), "q")
    got = cluster.concepts(samples, edges, "q", "s").orderBy("q", "s").collect()
    assert [(r.q, r.s, r.concept, r["size"]) for r in got] == [(1, 0, 1, 1), (1, 1, 0, 3), (1, 2, 0, 3), (1, 3, 0, 3), (2, 0, 0, 1), (2, 1, 1, 1)]
    assert near(got[1].probability, 3 / 4)


def greedy_by_hand(n, equal):
    """Each sample's class, by first samples in turn; a later first sample takes over what it equals."""
    firsts = []
    for j in range(n):
        if not any((i, j) in equal for i in firsts):
            firsts.append(j)
    own = {j: max((i for i in firsts if i < j and (i, j) in equal), default=j) for j in range(n)}
    return [firsts.index(j if j in firsts else own[j]) for j in range(n)]


def test_greedy_classes(spark):
    draw, rows, want = random.Random(5), [], {}
    for q in range(40):
        n = draw.randrange(2, 7)
        equal = {(i, j) for i in range(n) for j in range(n) if i != j and draw.random() < 0.35}
        rows += [(q, n, i, j, (i, j) in equal) for i in range(n) for j in range(n) if i != j]
        want[q] = greedy_by_hand(n, equal)
    got = cluster.greedy_classes(spark.createDataFrame(rows, "q long, n long, i long, j long, equal boolean"), "q", "n")
    assert {r.q: r.classes for r in got.collect()} == want


def test_greedy_classes_at_halves(spark, tmp_path):
    """Means whose half is lost in binary are rounded as SQL rounds them."""
    import duckdb

    from veridelta.plans import load

    plans, folder = load(), tmp_path / "sf"
    folder.mkdir()
    rows = [(u, e, v) for u, m in ((1, 1.005), (2, 8.345), (3, 2.675)) for e, v in (("a", m), ("b", round(m + 1.995, 2)), ("c", 50.0))]
    pd.DataFrame(rows, columns=["user_id", "event_type", "value"]).to_parquet(folder / "events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = {(r.user_id, r.classes) for r in plans.QUERIES["greedy_classes"](spark, str(folder)).collect()}
    assert got == set(db.sql(plans.ORACLES["greedy_classes"]).fetchall())


def test_greedy_classes_sum_in_the_order_of_rows(spark, tmp_path):
    """A mean on a half depends on the order of its sum: rows of a user lie far apart and in files of their own."""
    import duckdb

    from veridelta.plans import load

    plans, folder, draw = load(), tmp_path / "sf", random.Random(9)
    (folder / "events.parquet").mkdir(parents=True)
    # means that are exactly halves of a hundredth, by sums of four, eight and sixteen values
    rows = []
    for u in range(400):
        for e in "abc":
            n = draw.choice((4, 8, 16))
            cents = [draw.randrange(1, 900) for _ in range(n - 1)]
            cents.append((n // 2 - sum(cents)) % n + n * draw.randrange(40))
            rows += [(u, e, c / 100) for c in cents]
    rows += [(500, "a", None), (500, "b", 1.0), (501, "a", float("nan")), (501, "b", 2.0), (None, "a", 0.005), (None, "b", 1.0)]
    draw.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["user_id", "event_type", "value"]).astype({"user_id": "Int64"})
    for k in range(3):
        frame[k * 4000 : (k + 1) * 4000 if k < 2 else None].to_parquet(folder / f"events.parquet/part-{k}.parquet", row_group_size=500)
    db = duckdb.connect()
    db.sql("SET threads = 1")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    got = {(r.user_id, r.classes) for r in plans.QUERIES["greedy_classes"](spark, str(folder)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == set(db.sql(plans.ORACLES["greedy_classes"]).fetchall())
    means = flows._rounded_means(spark.read.parquet(f"{folder}/events.parquet"), ["user_id", "event_type"], "value")
    got = {(r.user_id, r.event_type): r.v for r in means.collect()}
    want = {(u, e): v for u, e, v in db.sql("SELECT user_id, event_type, round(avg(value), 2) FROM events GROUP BY ALL").fetchall()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


def test_equivalence_rules(spark):
    e, n, c = (F.lit(x) for x in ("entailment", "neutral", "contradiction"))
    row = spark.range(1).select(
        cluster.equivalent(e, e).alias("a"), cluster.equivalent(e, n).alias("b"), cluster.equivalent(e, n, False).alias("c"),
        cluster.equivalent(n, n, False).alias("d"), cluster.equivalent(e, c, False).alias("e"), cluster.contradicts(F.lit(0.6)).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, False, False, True)


def test_response_entropies(spark):
    rows = spark.createDataFrame([(1, 0, [-1.0, -3.0], 0), (1, 1, [-2.0], 0), (1, 2, [-4.0], 1)], "q long, r long, l array<double>, k long")
    got = uncertainty.response_entropies(rows, "q", "r", "l", "k").first()
    mass = [2 * math.exp(-2), math.exp(-4)]
    share = [m / sum(mass) for m in mass]
    assert near(got.regular_entropy, 8 / 3) and near(got.semantic_entropy, -sum(p * math.log(p) for p in share))
    assert near(got.cluster_assignment_entropy, -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))
    with pytest.raises(ValueError):
        uncertainty.response_entropies(rows.where("r = 0"), "q", "r", "l", "k")
    with pytest.raises(ValueError):
        uncertainty.response_entropies(rows.withColumn("l", F.array().cast("array<double>")), "q", "r", "l", "k")


def test_profile_and_key_tokens(spark):
    samples = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x")], "q long, s long, k string")
    tokens = spark.createDataFrame([(1, 0, "river", -1.0), (1, 0, "the", -9.0), (1, 1, "!", -9.0), (2, 0, "of", -2.0)], "q long, s long, t string, l double")
    got = uncertainty.profile(samples, tokens, "q", "s", "k", "l", "t").orderBy("q").collect()
    assert near(got[0].se, 1) and near(got[0].u_token, 1 / math.log(2)) and (got[1].se, got[1].u_token) == (0, 0)
    assert [(d.k, d.probability) for d in got[0].distribution] == [("x", 0.5), ("y", 0.5)]
    assert near(uncertainty.regular_entropy(tokens.where("q = 1"), "q", "s", "l").first().regular_entropy, (5 + 9) / 2)


def test_affirmative_token(spark):
    one = lambda m: spark.createDataFrame([(m,)], "m map<string,double>").select(uncertainty.affirmative_logprob(F.col("m")).alias("x")).first().x
    assert one({"B": -1.0, "A": -2.0, "▁A": -3.0}) == -3.0 and one({"A ": -2.5}) == -2.5
    with pytest.raises(Exception, match="isn't among"):
        one({"B": -1.0})


def test_few_shots(spark):
    rows = spark.createDataFrame([(i, ["a"] if i % 2 else []) for i in range(40)], "i long, answers array<string>").repartition(3)
    got = sorted(r.i for r in uncertainty.few_shots(rows, "i", "answers", 0.5, 4, 9).collect())
    assert got == sorted(r.i for r in uncertainty.few_shots(rows.repartition(5), "i", "answers", 0.5, 4, 9).collect())
    assert all(i < 20 and i % 2 for i in got) and len(got) == 4
    with pytest.raises(ValueError):
        uncertainty.few_shots(rows, "i", "answers", 0.1, 4, 9)


def test_evidence_and_run_metrics(spark):
    schema = """run long, kind string, answer string, gold_answer string, gold_urls array<string>, initial_urls array<string>,
      retrieved_urls array<string>, steps array<struct<triggered: boolean, min_probability: double>>, retrieval_calls int, active_calls int,
      finished boolean, forced boolean, final_triggered boolean, clean boolean, exact boolean, matched boolean, stop_reason string, end_reason string"""
    rows = [
        (1, "x", "The owl", "owl", ["u", "v", "u"], ["u"], ["w"], [(True, 0.5), (False, None)], 3, None, True, None, None, True, True, True, "s", None),
        (2, None, "cat", "dog", [], None, [], [], None, 2, False, True, None, True, None, None, None, None),
    ]
    got = {r.question_type: r for r in reports.run_metrics(spark.createDataFrame(rows, schema), "kind").collect()}
    assert set(got) == {None, "x", "unknown"} and got[None].examples == 2
    assert (got[None].answer_em, got["x"].initial_evidence_recall, got["x"].cumulative_evidence_precision) == (0.5, 0.5, 0.5)
    assert got["unknown"].initial_evidence_recall == 0 and got[None].initial_evidence_recall == 0.5
    assert (got["x"].avg_active_retrieval_calls, got["unknown"].avg_active_retrieval_calls, got["x"].active_step_trigger_rate) == (1, 2, 0.5)
    assert got[None].reasoning_stop_reasons == {"s": 1, reports.UNKNOWN: 1} and got[None].mean_draft_min_probability == 0.5
    assert got["x"].all_evidence_success == 0 and reports.versions(spark.createDataFrame(rows, schema), "kind").count() == 2


def test_run_metrics_tell_what_is_not_recorded(spark):
    schema = """run long, answer string, gold_answer string, gold_urls array<string>, initial_urls array<string>, retrieved_urls array<string>,
      steps array<struct<triggered: boolean, min_probability: double, retrieved: array<string>>>, retrieval_calls int, active_calls int,
      finished boolean, forced boolean, final_triggered boolean, clean boolean, exact boolean, matched boolean, stop_reason string,
      end_reason string, generation string"""
    rest = (1, None, True, None, None, None, True, None, None, None)
    rows = [
        (1, "a", "a", ["u", "v"], None, ["w"], [(True, 0.5, ["u"]), (False, 0.5, ["v"])], *rest, "plain"),
        (2, "a", "a", ["u"], None, [], None, *rest, "a ▁sign"),
        (3, "a", "a", ["u"], ["x"], [], [(True, 0.5, ["u"])], *rest, None),
    ]
    got = reports.run_metrics(spark.createDataFrame(rows, schema)).first()
    assert got.clean_output_rate == 2 / 3 and got.answer_extraction_pattern_match_rate == 1
    assert got.initial_evidence_recall == 0.5 / 3


def test_summaries_of_nothing(spark):
    rows = spark.createDataFrame([], "correct boolean, a double, b double")
    got = reports.answer_summary(rows, "correct", "a", "b").first()
    assert (got.examples, got.em, got.auroc_semantic_incorrect) == (0, 0, None)
    rows = spark.createDataFrame([], "i long, se double, d string")
    assert reports.pipeline_stats(rows, "i", "se", "d").first().confident_stops_pct == 0


def test_bm25_ranks_and_fills(spark):
    docs = spark.createDataFrame([(0, 0, "red fox"), (0, 1, "blue fox fox"), (1, 0, "green owl"), (2, 0, "plain text"), (3, 0, "more")], "d long, c int, t string")
    asked = spark.createDataFrame([(1, "fox"), (2, ""), (3, "owl")], "q long, t string")
    got = retrieval.bm25(asked, docs, "q", "t", "d", "c", "t", 3).orderBy("query", "rank").collect()
    assert [(r.query, r["rank"], r.doc) for r in got] == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (3, 1, 1), (3, 2, 0), (3, 3, 2)]
    assert got[0].chunk == 1 and got[1].score == 0


def test_bm25_titles_gaps_and_plain_scores(spark):
    draw = random.Random(3)
    words = [f"t{i}" for i in range(12)]
    docs = [(d, c, " ".join(draw.choice(words) for _ in range(draw.randrange(1, 15)))) for d in range(9) for c in range(2)]
    frame = spark.createDataFrame(docs, "d long, c int, t string").withColumn("title", F.lit("t0"))
    asked = spark.createDataFrame([(1, "t1 t2 t2"), (2, "t5")], "q long, t string")
    got = retrieval.bm25(asked, frame, "q", "t", "d", "c", "t", 20, title="title").collect()
    bags = {(d, c): Counter(["t0", *t.split()]) for d, c, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    raw = {w: math.log(len(bags) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for r in got:
        terms = {1: ["t1", "t2", "t2"], 2: ["t5"]}[r.query]
        score = lambda b: sum(idf.get(w, 0) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in terms)
        assert abs(r.score - max(score(bags[r.doc, c]) for c in range(2))) < 2e-6
    assert len(got) == 18
    retrieval.contiguous(frame, "c", "d")
    with pytest.raises(ValueError):
        retrieval.contiguous(frame.where("c > 0"), "c", "d")


def test_dense_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 3)
    monkeypatch.setattr(retrieval, "TILE_ITEMS", 10)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(45, 4))
    x[7] = x[8]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    asked = frame.where("i < 8").withColumnRenamed("i", "q")
    had = spark.createDataFrame([(0, 5), (0, 6), (3, 7)], "q long, i long").join(frame, "i")
    got = retrieval.dense_top_k(asked, frame, had, "q", "i", "v", 4, near=0.9).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    held = {0: [5, 6], 3: [7]}
    for q in range(8):
        good = [i for i in range(45) if not any(i == h or u[i] @ u[h] >= 0.9 for h in held.get(q, []))]
        want = sorted(good, key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:4]
        assert [r.item for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] == want


def plain_tile(asked, own, ids, had, k, near):
    """Each query's k best by all scores, each sorted whole."""
    found = []
    for q, held in zip(range(len(asked)), had):
        scores = np.round(own @ asked[q], 6)
        for i, v in held:
            scores[(ids == i) | (own @ np.array(v) >= near)] = -np.inf
        order = np.lexsort((ids, -scores))[:k]
        found += [(q, int(ids[i]), float(scores[i])) for i in order if scores[i] > -np.inf]
    return found


def tile_tables(asked, own, ids, had):
    vectors, held = pa.list_(pa.float64()), pa.list_(pa.struct([("i", pa.int64()), ("v", pa.list_(pa.float64()))]))
    some = [[{"i": int(i), "v": list(v)} for i, v in h] or None for h in had]
    queries = {"query": pa.array(range(len(asked))), "q": pa.array(asked.tolist(), vectors), "had": pa.array(some, held)}
    return pa.table(queries), pa.table({"item": pa.array(ids), "v": pa.array(own.tolist(), vectors)})


def by_query(table):
    return sorted(((r["query"], r["item"], r["score"]) for r in table.to_pylist()), key=lambda r: (r[0], -r[2], r[1]))


@pytest.mark.parametrize("near", [-0.5, 0.6, 0.95, 2.0])
def test_a_tile_passes_over_no_match(monkeypatch, near):
    draw = np.random.default_rng(7)
    for cell, n, k in ((3, 400, 5), (16, 300, 1), (64, 2, 4), (8, 250, 9)):
        monkeypatch.setattr(retrieval, "CELL", cell)
        monkeypatch.setattr(retrieval, "TOGETHER", 7)
        # few distinct vectors with many copies and ties, some zero, one that isn't a number
        whole = draw.integers(-1, 3, (n + 40, 3)).astype(float)
        norms = np.linalg.norm(whole, axis=1, keepdims=True)
        whole = whole / np.where(norms > 0, norms, 1)
        asked, own, ids = whole[:40], whole[40:], draw.permutation(n) * 3
        had = [[(ids[j], own[j]) for j in draw.integers(0, n, draw.integers(0, 4))] for _ in asked]
        own[0] = own[0] if any(i == ids[0] for h in had for i, _ in h) else np.nan
        assert by_query(retrieval._tile_top(k, near)(None, *tile_tables(asked, own, ids, had))) == plain_tile(asked, own, ids, had, k, near)


def test_a_tile_sorts_and_multiplies_only_what_is_close():
    draw = np.random.default_rng(8)
    middles = draw.normal(size=(300, 12))
    own = middles[draw.integers(0, 300, 60_000)] + 0.05 * draw.normal(size=(60_000, 12))
    asked = middles[draw.integers(0, 300, 1000)] + 0.05 * draw.normal(size=(1000, 12))
    own, asked = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (own, asked))
    ids, had = np.arange(60_000), [[(0, own[0])]] * 1000
    tables = tile_tables(asked, own, ids, had)
    began = time.time()
    want = plain_tile(asked, own, ids, had, 5, 0.985)
    plain, began = time.time() - began, time.time()
    got = retrieval._tile_top(5, 0.985)(None, *tables)
    assert time.time() - began < plain / 3 and by_query(got) == want


def test_claim_queries(spark):
    rows = spark.createDataFrame([(1, ["a b", "c"]), (2, []), (3, None)], "q long, c array<string>")
    assert [tuple(r) for r in retrieval.claim_queries(rows, "q", "c").collect()] == [(1, "a b c")]


def test_logits_don_t_see_scale(spark):
    rows = spark.createDataFrame([(1, float(i)) for i in (0, 3, 5)] + [(2, 4.0 * i - 2) for i in (0, 3, 5)] + [(3, 6.5)], "q long, s double")
    got = rows.withColumn("l", retrieval.retrieval_logits("s", "q")).orderBy("q", "s").collect()
    assert [round(r.l, 9) for r in got[:3]] == [round(r.l, 9) for r in got[3:6]] and got[6].l == 0


def test_gumbel_sets(spark):
    rows = spark.createDataFrame([(1, i, i / 10) for i in range(10)], "q long, i long, l double")
    one = retrieval.gumbel_sets(rows, "q", "i", "l", 5, 5, 3).orderBy("draw").collect()
    assert one == retrieval.gumbel_sets(rows, "q", "i", "l", 5, 5, 3).orderBy("draw").collect()
    assert all(len(set(r["items"])) == 5 for r in one)


def test_records(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"q_id": "1", "question": "q", "answers": ["a"], "ctxs": [{"id": "c", "title": "Rivers", "text": "They run", "score": "2.5"}]}\n\n')
    schema = "q_id string, question string, answers array<string>, ctxs array<struct<id: string, title: string, text: string, score: string>>"
    rows = records.read_json_lines(spark, f"file://{path}", schema, ("q_id", "ctxs"))
    got = records.record_chunks(records.not_empty(rows), 1).first()
    assert (got.text, got.score) == ("Rivers\nThey run", "2.5")
    with pytest.raises(ValueError):
        records.with_columns(rows, ("missing",))
    with pytest.raises(ValueError):
        records.not_empty(rows.limit(0))
    assert records.unfinished(rows, rows, ["q_id"]).count() == 0
    with pytest.raises(Exception, match="no passages"):
        records.record_chunks(rows.withColumn("ctxs", F.slice("ctxs", 1, 0)), 1).collect()
    with pytest.raises(ValueError):
        records.read_json_list(spark, f"file://{path}", schema)
    listed = tmp_path / "l.json"
    listed.write_text(' [{"q_id": "7"}, {"q_id": "8"}]')
    assert records.read_json_list(spark, f"file://{listed}", "q_id string").count() == 2


def test_version_guard_and_merge(spark):
    rows = spark.createDataFrame([(1, "v1", 5)], "k long, version string, x long")
    assert records.same_version(rows, "version", "v1").count() == 1
    with pytest.raises(ValueError):
        records.same_version(rows, "version", "v2")
    more = spark.createDataFrame([(1, None)], "k long, x long")
    assert records.merged(rows, more, "k").first().x is None


def test_loaders(spark):
    rows = spark.createDataFrame([("q", None, "obj"), ("r", '["a", "b"]', "obj"), ("s", "plain", "obj")], "question string, possible_answers string, obj string")
    rows = rows.withColumn("s_pop", F.lit(1).cast("long"))
    assert [r.gold_answers for r in records.popularity_questions(rows).orderBy("query").collect()] == [["obj"], ["a", "b"], ["plain"]]
    rows = spark.createDataFrame(
        [("q", "a", "hard", "bridge", (["T"], [["one.", "two."]]))],
        "question string, answer string, level string, type string, context struct<title: array<string>, sentences: array<array<string>>>",
    )
    questions, chunks = records.multihop_questions(rows)
    assert questions.first().gold_answers == ["a"] and chunks.first().text == "T: one. two."


def test_more_loaders(spark):
    one = spark.createDataFrame([("q", "yes")], "question string, answer string")
    many = spark.createDataFrame([("q", ["yes", "no"])], "question string, answer array<string>")
    assert records.open_questions(one).first().gold_answers == ["yes"]
    assert records.open_questions(many).first().gold_answers == ["yes", "no"]
    rows = spark.createDataFrame([("q", (["x"], "v")), ("r", ([], "v"))], "question string, answer struct<aliases: array<string>, value: string>")
    assert [r.gold_answers for r in records.aliased_questions(rows).orderBy("query").collect()] == [["x"], ["v"]]
    layout, modality, names = records.dataset("tatqa")
    assert layout is records.table_questions and modality == "table" and "numeric" in names
    with pytest.raises(ValueError):
        records.dataset("other")


def test_table_and_image_loaders(spark):
    schema = """id long, table array<array<string>>, paragraphs array<struct<text: string>>,
      questions array<struct<uid: string, question: string, answer: string, answer_type: string, scale: string>>"""
    rows = spark.createDataFrame([(5, [["a"]], [("one",), ("two",)], [("u", "q", '["x", "y"]', "span", None), (None, "r", "7", None, "%")])], schema)
    questions, chunks = records.table_questions(rows, "id")
    got = questions.orderBy("query").collect()
    assert [(r.query_id, r.gold_answers, r.scale, r.derivation) for r in got] == [("u", ["x", "y"], "", ""), ("tatqa_5_1", ["7"], "%", "")]
    assert [(r.pos, r.modality, r.text) for r in chunks.orderBy("pos").collect()] == [(0, "table", None), (1, "text", "one"), (2, "text", "two")]
    plain = rows.withColumn("paragraphs", F.array(F.lit("p"))).withColumn("questions", F.array(F.struct(F.lit("q").alias("question"), F.array(F.lit("z")).alias("answer"))))
    questions, chunks = records.table_questions(plain, "id")
    assert questions.first().gold_answers == ["z"] and chunks.where("pos = 1").first().text == "p"
    fact = "array<struct<fact: string, snippet: string, caption: string, image_url: string>>"
    rows = spark.createDataFrame(
        [("g", "q", ["a"], "c", [(None, None, "cap", "http://i")], [("f", None, None, None)], [], [(None, "s", None, None)])],
        f"qid string, Q string, A array<string>, Qcate string, img_posFacts {fact}, txt_posFacts {fact}, img_negFacts {fact}, txt_negFacts {fact}",
    )
    questions, chunks = records.multimodal_questions(rows)
    got = {(r.modality, r.text, r.image, r.is_positive) for r in chunks.collect()}
    assert got == {("image", "cap", "http://i", True), ("text", "f", None, True), ("text", "s", None, False)}
    assert questions.first().category == "c"


def test_sinks_and_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "boom")], "k long, v string, error string")
    good, bad = records.split_errors(rows, "error")
    assert [r.k for r in good.collect()] == [1] and good.columns == ["k", "v"]
    with pytest.raises(RuntimeError, match="1 rows failed: 2: boom"):
        records.raise_failures(bad, "k", "error")
    records.raise_failures(bad.limit(0), "k", "error")
    path = f"file://{tmp_path}/out"
    for _ in range(2):
        records.write_json(good, path)
    assert spark.read.json(path).count() == 1
    records.append_json(good, path)
    assert spark.read.json(path).count() == 2
    records.write_summary(rows.groupBy().agg(F.count("*").alias("n"), F.max(F.lit(None).cast("int")).alias("none")), f"{path}-s")
    assert '"none":null' in "".join(p.read_text() for p in (tmp_path / "out-s").glob("*.json"))
    with pytest.raises(ValueError):
        records.write_summary(rows, f"{path}-s")
    assert [r.value for r in records.predictions(rows, "k", "v", "error").orderBy("value").collect()] == ['{"1":["a",""]}', '{"2":["b","boom"]}']
    assert [r.iteration for r in records.iteration_log(rows.withColumn("q", F.lit(0)), "q", "k").orderBy("k").collect()] == [0, 1]
    more = spark.createDataFrame([(1, 5)], "k long, w long")
    assert records.looked_up(good, more, ["k"]).first().w == 5
    with pytest.raises(KeyError):
        records.looked_up(rows, more, ["k"])
    good.write.parquet(f"{path}-p")
    assert records.setup_problems(spark, {f"{path}-p": ("k",)}) == []
    assert len(records.setup_problems(spark, {f"{path}-p": ("z",), f"{path}-none": ()})) == 2


def test_settings(spark, tmp_path):
    one, two = tmp_path / "a.json", tmp_path / "b.json"
    one.write_text('{"sampling": {"adaptive_M_enabled": true, "M_initial": 2, "M_max": 5}, "retrieval": {"top_k": 4}}')
    two.write_text('{"sampling": {"M_max": 9}}')
    own = settings.load(spark, f"file://{one}", f"file://{two}")
    assert own["sampling"] == {"adaptive_M_enabled": True, "M_initial": 2, "M_max": 9}
    own |= {"pruning": {}, "thresholds": {}}
    variants = settings.ablations(own)
    assert variants["no_retrieve"]["retrieval"]["top_k"] == 0 and own["retrieval"]["top_k"] == 4
    with pytest.raises(ValueError):
        settings.layered(own, {"sampling": {"M_max": 2}})
    settings.check_active(0.5, 0, steps=1)
    with pytest.raises(ValueError):
        settings.check_active(1.5, 0)
    with pytest.raises(ValueError):
        settings.check_active(0.5, 0, steps=0)
    assert settings.entailment_index({0: "CONTRADICTION", 2: "Entailment"}, "m", {}) == 2
    assert settings.entailment_index({0: "a", 1: "b"}, "some-nli", {"nli": 1}) == 1
    with pytest.raises(ValueError):
        settings.entailment_index({0: "a"}, "m", {})


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    plans, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(plans)
    assert entry.entry(spark).columns == ["query", "rank", "doc", "chunk", "score"]


def test_bm25_sends_few_rows(spark, monkeypatch):
    """What leaves a task is each query's k best, however many tiles it takes; the same as by the join of all terms."""
    draw = random.Random(7)
    docs = [(d, c, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9)))) for d in range(300) for c in range(1 + d % 3)]
    docs += [(1000 + d, 0, "a b c") for d in range(200)]  # ties go to the lesser document
    frame = spark.createDataFrame(docs, "d long, c int, t string").repartition(3, "d")
    asked = spark.createDataFrame([(f"q{i}", " ".join(draw.choice("abcdefghz") for _ in range(3))) for i in range(20)], "q string, t string")
    found = lambda: sorted(map(tuple, retrieval.bm25(asked, frame, "q", "t", "d", "c", "t", 4).collect()))
    sent, weighed = [], retrieval._weighed
    monkeypatch.setattr(retrieval, "_weighed", lambda *args: sent.append(weighed(*args)) or sent[-1])
    got = [found()]
    monkeypatch.setattr(retrieval, "MOST_MET", 50)
    monkeypatch.setattr(retrieval, "MOST_SCORES", 100)
    got.append(found())
    assert all(df.count() <= 20 * 4 * df.rdd.getNumPartitions() for df in sent)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 0)
    assert got[0] == got[1] == found()
    assert sent[-1].count() > 20 * 4 * 3  # one row for every query and chunk


def test_shared_runs(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b\u2003c d e"), (2, None), (3, "b c d b c d"), (4, "c d"), (5, "")], "d long, t string")
    wanted = spark.createDataFrame([("b c d",), ("d e f",), ("c d e",), ("b c d",)], "run string")
    found = lambda: sorted(map(tuple, retrieval.shared_runs(rows, "d", "t", wanted, 3).collect()))
    assert found() == [(1, "b c d"), (1, "c d e"), (3, "b c d")]
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 0)
    assert found() == [(1, "b c d"), (1, "c d e"), (3, "b c d")]


def test_bm25_refuses_chunks_with_gaps(spark):
    docs = spark.createDataFrame([(1, 0, "owl"), (1, 2, "mice")], "d long, c int, t string")
    asked = spark.createDataFrame([(1, "owl")], "q long, t string")
    with pytest.raises(ValueError, match="numbered from 0"):
        retrieval.bm25(asked, docs, "q", "t", "d", "c", "t", 3)
