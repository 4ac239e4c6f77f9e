"""Claims by a model, key tokens, search by claims, checks of a setup, sums of far apart log-probabilities."""

import json
import math

import pytest
from pyspark.sql import functions as F

from veridelta.operators import retrieval, samples, uncertainty
from veridelta.sources import records

TEMPLATES = {kind: kind + ": {text}" for kind in ("text", "table", "image")}


def model_of(log, spark):
    """A model that lists its prompts in an accumulator and fails on one text."""
    count = spark.sparkContext.accumulator(0)
    log.append(count)

    def build():
        def model(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no answer")
            count.add(len(prompts))
            return [None if "none" in p else json.dumps({"claims": [p, "  "]}) for p in prompts]

        return model

    return build


ROWS = [
    (1, "a b", "text"),
    (2, "a b", "text"),
    (3, "a b", "table"),
    (4, "a b", "multimodal"),
    (5, "a b", None),
    (6, " \n ", "text"),
    (7, None, "image"),
    (8, "none at all", "image"),
    (9, "bad", "text"),
]


def test_claims_are_asked_for_once_by_modality(spark):
    log = []
    rows = spark.createDataFrame(ROWS, "id int, text string, modality string")
    own = samples.claims_by_model(rows, "text", F.col("modality"), TEMPLATES, model_of(log, spark), batch=3)
    got = {r.id: r for r in own.collect()}
    assert len(got) == len(ROWS)
    assert [got[i].claims for i in (1, 2, 3, 4, 5)] == [[f"{k}: a b"] for k in ("text", "text", "table", "image", "text")]
    assert got[6].claims == got[7].claims == [] and got[8].claims == ["none at all"]
    assert got[9].claims is None and got[9].error.kind == "ValueError" and "no answer" in got[9].error.message
    assert all(got[i].error is None for i in range(1, 9))
    # three distinct prompts of "a b" and one that has no answer; blank texts aren't asked about
    assert log[0].value == 4
    own.count()
    assert log[0].value == 4


def test_all_of_a_sample(spark):
    tokens = [("The", -0.1), (" Paris", -0.2), ("!!", -0.3), (None, -0.4), (" 42", -0.5)]
    rows = spark.createDataFrame([(1, "x y", tokens), (2, "", None), (3, "z", [])], "id int, text string, t array<struct<token string, logprob double>>")
    own = samples.extract_all(rows, "text", "t", F.lit("text"), TEMPLATES, model_of([], spark))
    got = {r.id: ([(t.token, t.logprob) for t in r.key_tokens], r.claims) for r in own.collect()}
    assert got == {1: ([(" Paris", -0.2), (" 42", -0.5)], ["text: x y"]), 2: ([], []), 3: ([], ["text: z"])}


def test_no_samples(spark):
    rows = spark.createDataFrame([], "id int, text string, t array<struct<token string>>")
    assert samples.extract_all(rows, "text", "t", F.lit("text"), TEMPLATES, model_of([], spark)).count() == 0


def encode():
    return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]


def test_search_by_claims(spark):
    said = spark.createDataFrame([(1, ["a", "ab"]), (2, []), (3, None), (4, ["b"])], "q int, claims array<string>")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 3.0])], "i int, v array<double>")
    had = spark.createDataFrame([(4, 3, [0.0, 1.0])], "q int, i int, v array<double>")
    find = lambda **kw: sorted((r.query, r["rank"], r.item) for r in samples.claim_search(said, items, had, "q", "i", "v", encode, **kw).collect())
    # the one that question 4 has goes, and so does the one in the same direction
    assert find(top_k=2) == [(1, 1, 2), (1, 2, 1), (4, 1, 2), (4, 2, 1)]
    assert find(k=1, top_k=2) == [(1, 1, 2), (4, 1, 2)] and find(k=0, top_k=1) == find(k=1)
    assert samples.claim_search(said, items.limit(0), had, "q", "i", "v", encode).count() == 0


def test_an_encoder_that_fails_is_an_error(spark):
    said = spark.createDataFrame([(1, ["a"])], "q int, claims array<string>")
    items = spark.createDataFrame([(1, [1.0])], "i int, v array<double>")
    had = spark.createDataFrame([], "q int, i int, v array<double>")

    def broken():
        def model(texts):
            raise ValueError("out of order")

        return model

    with pytest.raises(Exception, match="no vector: out of order"):
        samples.claim_search(said, items, had, "q", "i", "v", broken).collect()


def test_setup_counts_and_evidence(spark):
    questions = spark.createDataFrame([(1, ["u", "v"]), (2, []), (3, ["w", "w", None]), (4, None)], "q int, urls array<string>")
    corpus = spark.createDataFrame([("u",), ("v",), (None,)], "url string")
    assert sorted((r.q, r.url or "") for r in records.uncovered(questions, "urls", corpus, "url", "q").collect()) == [(3, ""), (3, "w"), (3, "w")]
    with pytest.raises(ValueError, match="questions: 4 rows, 5 expected; corpus: lacks 3 urls"):
        records.check_setup(questions, "urls", corpus, "url", "q", 5, 3)
    records.check_setup(questions.where("q <= 2"), "urls", corpus, "url", "q", 2, 3)


def test_masses_of_far_apart_log_probabilities(spark):
    rows = [(1, "a", -5000.0), (1, "a", -5001.0), (1, "b", -5000.5), (2, "a", 900.0), (2, "b", 100.0), (3, "a", -0.1), (3, "b", float("-inf"))]
    own = spark.createDataFrame(rows, "q int, k string, l double")
    got = {(r.q, r.k): r.log_mass for r in uncertainty.cluster_mass(own, "q", "k", "l").collect()}
    both = math.log(math.exp(0) + math.exp(-1) + math.exp(-0.5))
    assert got[1, "a"] == pytest.approx(math.log(1 + math.exp(-1)) - both) and got[1, "b"] == pytest.approx(-0.5 - both)
    assert got[2, "a"] == pytest.approx(0.0) and got[3, "a"] == pytest.approx(0.0) and got[3, "b"] is None
    # less than a double can hold beside the largest
    assert got[2, "b"] is None or got[2, "b"] == pytest.approx(-800.0)


def test_probabilities_of_groups_equal_those_by_windows(spark):
    rows = [(i % 3 if i % 3 < 2 else None, float(i * i % 17), i) for i in range(40)]
    rows += [(7, 0.5, 100), (7, 0.5, 101), (8, 2.0, 102), (9, None, 103), (9, 1.0, 104), (9, 3.0, 105)]
    df = spark.createDataFrame(rows, "g int, s double, i int")
    plain = df.withColumn("l", retrieval.retrieval_logits("s", "g", 0.5)).withColumn("p", retrieval.softmax("l", "g"))
    want = {r.i: (r.l, r.p) for r in plain.collect()}
    got = {r.i: (r.logit, r.probability) for r in retrieval.retrieval_probabilities(df, "g", "s", 0.5).collect()}
    assert len(got) == len(rows)
    for i, (l, p) in got.items():
        assert (l, p) == (None, None) if i == 103 else (l == pytest.approx(want[i][0]) and p == pytest.approx(want[i][1]))
    assert got[100] == (0.0, 0.5) and got[102] == (0.0, 1.0)
