"""Question loops: all questions step together as tables, and a step's models are functions from tables to tables.

A driver loop runs as many rounds as the longest question needs, at most the given number; each round is a few Spark jobs over
the questions that are still open, and its tables are written to the shared folder, so lineage doesn't grow. Models aren't
part of this: ``draw``, ``generate`` and ``retrieve`` are given, each a function of DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.text import final_answer, first_sentence, first_sentence_pieces, stripped
from veridelta.operators import control, uncertainty
from veridelta.operators.rounds import Progress
from veridelta.session import written

CONTEXT = ["query", "chunk", "text"]


def concatenated(context: DataFrame, more: DataFrame) -> DataFrame:
    """A context (query, chunk, text) with the chunks of ``more`` that a question doesn't have yet."""
    new = more.select(*CONTEXT).dropDuplicates(["query", "chunk"]).join(context.select("query", "chunk"), ["query", "chunk"], "left_anti")
    return context.select(*CONTEXT).unionByName(new)


@dataclass(frozen=True)
class Policy:
    """When the iterative loop retrieves, prunes and stops.

    With ``factors`` the thresholds are shares of a question's first values, not below ``floors``; without, they are
    ``fixed``. Pairs are for semantic entropy and token uncertainty."""

    rounds: int = 5
    fixed: tuple[float, float] = (0.5, 0.5)
    factors: tuple[float, float] | None = None
    floors: tuple[float, float] = (0.1, 0.1)
    patience: int = 2
    least_fall: float = 0.05


def iterate(
    questions: DataFrame,
    context: DataFrame,
    draw: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]],
    retrieve: Callable[[DataFrame], DataFrame],
    prune: Callable[[DataFrame, DataFrame], DataFrame],
    policy: Policy = Policy(),
    progress: Progress | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The steps (query, iteration, se, u, tau_semantic, tau_token, decision) of all questions, and their last contexts.

    ``draw(open, context)`` gives samples (query, sample, concept) and their tokens (query, sample, token, logprob);
    ``retrieve(asked)`` gives chunks (query, chunk, text) for questions; ``prune(asked, context)`` gives the chunks that stay.
    A question ends with STOP where it is certain, with CONVERGED where its entropy no longer falls, else with MAX_ROUNDS after
    the last round. A question without samples has entropy 0. With ``progress`` each round is committed, and a run goes on after
    the last committed one."""
    steps: DataFrame | None = None
    first = 0 if progress is None else progress.last + 1
    if first:
        for i in range(first):
            step = progress.table(i, "step")
            steps = step if steps is None else steps.unionByName(step)
        open_, context = progress.table(first - 1, "open"), progress.table(first - 1, "context")
        if open_.isEmpty():
            return steps, context
    else:
        open_ = written(questions.select("query").distinct(), "open")
        context = written(context.select(*CONTEXT), "context")
    for i in range(first, policy.rounds):
        samples, tokens = draw(open_, context)
        se = uncertainty.entropy(samples, ["query"], "concept").select("query", F.col("entropy").alias("se"))
        u = uncertainty.token_uncertainty(tokens, "query", "sample", "logprob", token="token")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
        own = open_.join(se, "query", "left").join(u.withColumnRenamed("u_token", "u"), "query", "left")
        own = own.select("query", F.lit(i).alias("iteration"), zero("se"), zero("u"))
        history = own if steps is None else steps.select("query", "iteration", "se", "u").unionByName(own)
        history = _with_thresholds(history, policy)
        history = control.converged(history, "query", "iteration", "se", policy.patience, policy.least_fall)
        now = history.where(F.col("iteration") == i)
        decision = control.route(F.col("se"), F.col("u"), F.col("tau_semantic"), F.col("tau_token"))
        ended = F.when(decision == "STOP", decision).when(F.col("converged"), "CONVERGED")
        ended = ended.when(F.lit(i == policy.rounds - 1), "MAX_ROUNDS").otherwise(decision)
        now = written(now.select("query", "iteration", "se", "u", "tau_semantic", "tau_token", ended.alias("decision")), "step")
        steps = now if steps is None else steps.unionByName(now)
        going = now.where(F.col("decision").isin("RETRIEVE", "PRUNE"))
        if going.isEmpty():
            if progress is not None:
                progress.commit(i, step=now, open=going.select("query"), context=context)
            break
        pruned = going.where("decision = 'PRUNE'").select("query")
        kept = prune(pruned, context.join(pruned, "query", "left_semi")).select(*CONTEXT)
        rest = context.join(pruned, "query", "left_anti").select(*CONTEXT)
        found = retrieve(going.where("decision = 'RETRIEVE'").select("query"))
        context = concatenated(rest, found).unionByName(kept)
        if progress is None:
            context, open_ = written(context, "context"), going.select("query")
        else:
            kept_tables = progress.commit(i, step=now, open=going.select("query"), context=context)
            open_, context = kept_tables["open"], kept_tables["context"]
    return steps, context


def _with_thresholds(history: DataFrame, policy: Policy) -> DataFrame:
    if policy.factors:
        return control.thresholds(history, "query", "iteration", policy.factors, policy.floors)
    return history.withColumns({"tau_semantic": F.lit(policy.fixed[0]), "tau_token": F.lit(policy.fixed[1])})


def active_retrieval(
    questions: DataFrame,
    generate: Callable[[DataFrame, DataFrame], DataFrame],
    retrieve: Callable[[DataFrame], DataFrame],
    theta: float = 0.4,
    beta: float = 0.4,
    rounds: int = 8,
    finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    progress: Progress | None = None,
) -> DataFrame:
    """(query, answer, steps, retrievals, reason): answers made sentence by sentence, with a look ahead.

    ``questions`` (query, question). ``retrieve(asked)`` (query, text) gives chunks (query, chunk, text);
    ``generate(open, context)`` (query, question, answer so far) gives drafts (query, text, pieces, logprobs), of which the first
    sentence counts. A draft with an uncertain piece is thrown away: what is certain of it is searched for, the found chunks
    replace the context, and the sentence is made again. A question ends where a sentence gives its final answer, is blank, or
    the rounds are over. For those that end without a final answer ``finish(ended, context)`` (query, question, answer so far)
    gives one more text (query, text), which is added. With ``progress`` each round is committed, and a run goes on after the
    last committed one."""
    first = 0 if progress is None else progress.last + 1
    if first:
        done = [progress.table(i, "done") for i in range(first)]
        state, context = progress.table(first - 1, "state"), progress.table(first - 1, "context")
    else:
        done = []
        state = questions.select(
            "query", "question", F.lit("").alias("answer"), F.lit(0).alias("steps"), F.lit(1).alias("retrievals")
        )
        state = written(state, "state")
        context = written(retrieve(state.select("query", F.col("question").alias("text"))).select(*CONTEXT), "context")
    for i in range(first, rounds):
        if first and i == first and state.isEmpty():
            break
        drafts = written(_drafts(generate(state.select("query", "question", "answer"), context)), "drafts")
        asked = drafts.join(state.select("query", "question"), "query").where(
            control.triggers(F.col("logprobs"), F.col("pieces"), theta)
        )
        masked = control.masked_query(F.col("pieces"), F.col("logprobs"), beta, F.col("question"))
        asked = written(asked.select("query", masked.alias("text")), "asked")
        found = retrieve(asked).select(*CONTEXT)
        context = context.join(asked, "query", "left_anti").select(*CONTEXT).unionByName(found)
        context = written(context, "context")
        again = state.join(asked.select("query"), "query", "left_semi").select("query", "question", "answer")
        second = _drafts(generate(again, context)).select("query", F.col("text").alias("better"))
        sentence = drafts.select("query", "text").join(second, "query", "left")
        sentence = sentence.select("query", stripped(F.coalesce("better", "text")).alias("sentence"))
        counted = asked.groupBy("query").agg(F.count("*").alias("more"))
        new = state.join(sentence, "query", "left").join(counted, "query", "left")
        said = F.coalesce("sentence", F.lit(""))
        reason = F.when(said == "", "blank").when(final_answer(said).isNotNull(), "final_answer")
        reason = reason.when(F.lit(i == rounds - 1), "max_rounds")
        new = new.select(
            "query",
            "question",
            stripped(F.concat_ws(" ", "answer", said)).alias("answer"),
            (F.col("steps") + 1).alias("steps"),
            (F.col("retrievals") + F.coalesce("more", F.lit(0))).cast("int").alias("retrievals"),
            reason.alias("reason"),
        )
        new = written(new, "state")
        ended = new.where("reason is not null")
        if finish is not None:
            ended = _finished(ended, context, finish)
        ended, state = ended.drop("question"), new.where("reason is null").drop("reason")
        if progress is not None:
            tables = progress.commit(i, done=ended, state=state, context=context)
            ended, state, context = tables["done"], tables["state"], tables["context"]
        done.append(ended)
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _finished(ended: DataFrame, context: DataFrame, finish) -> DataFrame:
    """The ended questions, those without a final answer with one more text."""
    short = ended.where(final_answer(F.col("answer")).isNull()).select("query", "question", "answer")
    more = finish(short, context.join(short, "query", "left_semi")).select("query", F.col("text").alias("more"))
    rows = ended.join(more.dropDuplicates(["query"]), "query", "left")
    answer = stripped(F.concat_ws(" ", "answer", stripped(F.col("more"))))
    return written(rows.withColumn("answer", answer).select(*ended.columns), "finished")


def _drafts(df: DataFrame) -> DataFrame:
    """One draft of a question, cut to its first sentence; its pieces and their log-probabilities are cut with it."""
    first = Window.partitionBy("query").orderBy("text")
    rows = df.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    rows = rows.withColumn("__p", first_sentence_pieces(F.col("text"), F.col("pieces")))
    logprobs = F.slice("logprobs", F.lit(1), F.size("__p")).alias("logprobs")
    return rows.select("query", first_sentence(F.col("text")).alias("text"), F.col("__p").alias("pieces"), logprobs)


def answer_rounds(
    questions: DataFrame,
    generate: Callable[[DataFrame, DataFrame], DataFrame],
    retrieve: Callable[[DataFrame], DataFrame],
    rounds: int = 0,
) -> DataFrame:
    """(query, answer): whole answers, made from what is found for the question, and again after each of some rounds in which
    question and answer together are searched for and what is found is added. No round: one answer."""
    state = questions.select("query", "question", F.lit("").alias("answer"))
    context = written(retrieve(state.select("query", F.col("question").alias("text"))).select(*CONTEXT), "context")
    for i in range(rounds + 1):
        said = generate(state, context).groupBy("query").agg(F.min("text").alias("said"))
        state = state.select("query", "question").join(said, "query", "left")
        state = written(state.select("query", "question", F.coalesce("said", F.lit("")).alias("answer")), "answers")
        if i < rounds:
            asked = state.select("query", stripped(F.concat_ws(" ", "question", "answer")).alias("text"))
            context = written(concatenated(context, retrieve(asked)), "context")
    return state.select("query", "answer")
