"""Question loops with models that are plain functions of the tables."""

import math

from pyspark.sql import functions as F

from veridelta.operators import cluster, control, loops

TEXT = "query long, chunk long, text string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_concatenated_context(spark):
    old, new = frame(spark, [(1, 0, "a")], TEXT), frame(spark, [(1, 0, "a"), (1, 1, "b"), (1, 1, "b"), (2, 0, "c")], TEXT)
    got = sorted((r.query, r.chunk) for r in loops.concatenated(old, new).collect())
    assert got == [(1, 0), (1, 1), (2, 0)]


def drawn(spark):
    """Samples agree once a question has three chunks; tokens are uncertain while it has a chunk marked as noise."""

    def draw(open_, context):
        n = context.groupBy("query").agg(F.count("*").alias("n"), F.max(F.col("text").contains("noise")).alias("noise"))
        own = open_.join(n, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("noise", F.lit(False)).alias("noise"))
        samples = own.select("query", "n", "noise", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sample"))
        concept = F.when(F.col("n") >= 3, 0).otherwise(F.col("sample") % 2)
        tokens = samples.select("query", "sample", F.lit("river").alias("token"), F.when(F.col("noise"), -2.0).otherwise(-0.01).alias("logprob"))
        return samples.select("query", "sample", concept.alias("concept")), tokens

    return draw


def test_iterative_loop(spark):
    questions = frame(spark, [(1,), (2,), (3,), (4,)], "query long")
    # 1 is certain, 2 must retrieve twice, 3 has noise, 4 never finds anything
    context = [(1, c, "x") for c in range(3)] + [(2, 0, "x")] + [(3, 0, "noise"), (3, 1, "x"), (3, 2, "x"), (3, 3, "x")]
    calls = []

    def retrieve(asked):
        calls.append(sorted(r.query for r in asked.collect()))
        return asked.where("query <> 4").select("query", F.lit(len(calls)).cast("long").alias("chunk"), F.lit("found").alias("text"))

    steps, last = loops.iterate(
        questions, frame(spark, context, TEXT), drawn(spark), retrieve,
        lambda asked, own: own.where("text not like '%noise%'"), loops.Policy(rounds=4, fixed=(0.5, 0.5), patience=3),
    )
    got = {}
    for r in steps.orderBy("query", "iteration").collect():
        got.setdefault(r.query, []).append(r.decision)
    assert got == {1: ["STOP"], 2: ["RETRIEVE", "RETRIEVE", "STOP"], 3: ["PRUNE", "STOP"], 4: ["RETRIEVE"] * 3 + ["CONVERGED"]}
    assert calls == [[2, 4], [2, 4], [4]]
    assert {r.query: r["count"] for r in last.groupBy("query").count().collect()} == {1: 3, 2: 3, 3: 3}
    steps, _ = loops.iterate(
        questions.where("query = 4"), frame(spark, [], TEXT), drawn(spark), retrieve, lambda asked, own: own,
        loops.Policy(rounds=2, factors=(0.5, 0.5), floors=(0.1, 0.1)),
    )
    assert [r.decision for r in steps.orderBy("iteration").collect()] == ["RETRIEVE", "MAX_ROUNDS"]
    assert steps.first().tau_semantic == 0.5


def test_active_retrieval_loop(spark):
    questions = frame(spark, [(1, "where is it"), (2, "who is it"), (3, "what")], "query long, question string")
    searched = []

    def retrieve(asked):
        searched.append({r.query: r.text for r in asked.collect()})
        return asked.select("query", F.lit(len(searched)).cast("long").alias("chunk"), F.col("text"))

    def generate(open_, context):
        found = context.groupBy("query").agg(F.max("chunk").alias("c"))
        own = open_.join(found, "query", "left")
        # 1 is unsure until something is found for its draft; 2 ends at once; 3 says nothing
        text = F.when(F.col("query") == 2, "So the answer is Ada.").when(F.col("query") == 3, "").when(
            F.col("answer") != "", "The answer is north."
        ).otherwise("It lies north.")
        sure = (F.col("query") != 1) | (F.col("c") > 1)
        pieces = F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(text, " "), lambda x: F.concat(x, F.lit(" "))))
        low = F.when(sure, 0.0).otherwise(math.log(0.1))
        logs = F.transform(pieces, lambda p, i: F.when(i == 1, low).otherwise(0.0))
        return own.select("query", text.alias("text"), pieces.alias("pieces"), logs.alias("logprobs"))

    got = {r.query: r for r in loops.active_retrieval(questions, generate, retrieve, 0.4, 0.4, 4).collect()}
    assert (got[1].answer, got[1].steps, got[1].retrievals, got[1].reason) == ("It lies north. The answer is north.", 2, 2, "final_answer")
    assert (got[2].reason, got[2].steps, got[2].retrievals) == ("final_answer", 1, 1) and got[3].reason == "blank"
    assert searched[1] == {1: "It north"}
    answers = loops.answer_rounds(questions, generate, retrieve, 1)
    assert {r.query: r.answer for r in answers.collect()} == {1: "The answer is north.", 2: "So the answer is Ada.", 3: ""}
    assert loops.answer_rounds(questions.limit(0), generate, retrieve).count() == 0


def test_small_pieces_of_the_loops(spark):
    row = spark.range(1).select(
        control.low_token_query(F.array(*map(F.lit, [" a", "b", "c "])), F.array(*map(F.lit, [-2.0, -0.5, -1.5]))).alias("q")
    )
    assert row.first().q == "a c"
    kinds = frame(spark, [(1, "null_query"), (2, None), (3, "x")], "q long, question_type string")
    assert sorted(r.q for r in control.answerable(kinds).collect()) == [2, 3]
    samples = frame(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "q long, s long, t string").withColumn("question", F.lit("why"))
    pairs = cluster.directed_pairs(samples, "q", "s", "t", "question")
    assert {(r.i, r.j, r.premise, r.hypothesis) for r in pairs.collect()} == {(0, 1, "why a", "why b"), (1, 0, "why b", "why a")}
    scores = pairs.withColumn("entailment", F.when(F.col("i") == 0, 0.9).otherwise(0.2))
    assert not any(r.equal for r in cluster.both_entail(scores).collect())
    assert all(r.equal for r in cluster.both_entail(scores.withColumn("entailment", F.lit(0.5))).collect())
