"""Contexts with a chunk left out, models as hooks, restartable loops, slices in order, numbered lines."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_loops import TEXT, drawn, frame
from veridelta.operators import hooks, leaveout, loops, slices, uncertainty
from veridelta.operators.rounds import Progress
from veridelta.sources import records

CHUNKS = "q long, c long, kind string, se double, score double, against double"


def chunk_rows():
    rows = [(1, c, "ab"[c % 2], 1.0, [0.95, 0.5, 0.5, 0.05][c % 4], [0.9, 0.1][c % 2]) for c in range(8)]
    return rows + [(2, 0, "a", 0.0, 0.5, None), (3, 0, "a", 0.4, 0.9, 0.1), (3, 1, "b", 0.4, 0.3, 0.1)]


def counting(calls):
    def evaluate(tests, contexts):
        calls.append(
            (
                sorted((r.q, r.left_out) for r in tests.collect()),
                sorted((r.q, r.left_out, r.c) for r in contexts.collect()),
            )
        )
        se = uncertainty.entropy(contexts, ["q", "left_out"], "kind").withColumnRenamed("entropy", "se_without")
        return tests.join(se, ["q", "left_out"], "left").select("q", "left_out", F.coalesce("se_without", F.lit(0.0)).alias("se_without"))

    return evaluate


def test_one_call_evaluates_all_questions(spark):
    calls, rows = [], frame(spark, chunk_rows(), CHUNKS)
    got = {(r.q, r.c): r for r in leaveout.prefix_caching(rows, "q", "c", "se", counting(calls), 3).collect()}
    assert len(calls) == 1
    tests, contexts = calls[0]
    assert tests == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)]
    assert contexts == sorted([(1, t, c) for t in range(3) for c in range(8) if c != t] + [(3, 0, 1), (3, 1, 0)])
    # a lone chunk leaves an empty context, of entropy 0: no larger than before, so the chunk goes
    assert not got[2, 0].kept and got[1, 5].kept and got[1, 5].se_without is None
    assert len(got) == len(chunk_rows())


def test_two_phase_leaves_out_of_what_does_not_contradict(spark):
    calls, rows = [], frame(spark, chunk_rows(), CHUNKS)
    got = {(r.q, r.c): r for r in leaveout.two_phase(rows, "q", "c", "se", counting(calls), "against", 0.8, 2).collect()}
    assert len(calls) == 1 and [t for t in calls[0][0] if t[0] == 1] == [(1, 1), (1, 3)]
    assert {c for q, _, c in calls[0][1] if q == 1} == {1, 3, 5, 7}
    assert got[1, 0].phase == "contradiction" and not got[1, 0].kept and got[1, 7].phase == "untested" and got[1, 7].kept


def test_gray_zone_leaves_out_of_kept_and_tested_ones(spark):
    calls, rows = [], frame(spark, chunk_rows(), CHUNKS)
    got = {(r.q, r.c): r for r in leaveout.gray_zone(rows, "q", "c", "se", counting(calls), "score", 0.9, 0.1).collect()}
    assert len(calls) == 1 and [t for t in calls[0][0] if t[0] == 1] == [(1, 1), (1, 2), (1, 5), (1, 6)]
    assert {c for q, _, c in calls[0][1] if q == 1} == {0, 1, 2, 4, 5, 6}
    assert got[1, 3].zone == "drop" and got[1, 3].place is None and got[3, 0].kept


def test_nothing_is_left_out_of_nothing(spark):
    empty = frame(spark, [], CHUNKS)
    assert leaveout.prefix_caching(empty, "q", "c", "se", counting([])).count() == 0


def logged(folder, fails=()):
    """A model that writes down when it is built and every input it is given."""

    def build():
        (folder / f"built-{__import__('uuid').uuid4().hex}").touch()

        def model(rows):
            with open(folder / f"calls-{__import__('os').getpid()}", "a") as f:
                f.write(json.dumps(rows) + "\n")
            if any(r[0] in fails for r in rows):
                raise KeyError("bad input")
            return [len(a or "") + len(b or "") for a, b in rows]

        return model

    return build


def calls_in(folder):
    return [json.loads(line) for p in folder.glob("calls-*") for line in p.read_text().splitlines()]


def test_hook_scores_distinct_inputs_in_batches(spark, tmp_path):
    rows = [(k, f"premise {k % 7}", None if k % 5 == 0 else "h") for k in range(500)]
    df = frame(spark, rows, "id long, a string, b string").repartition(6)
    got = hooks.scored(df, ["a", "b"], logged(tmp_path), "int", "score", batch=4)
    assert {r.id: r.score for r in got.collect()} == {k: len(a) + len(b or "") for k, a, b in rows}
    assert got.count() == 500 and got.where("error is not null").count() == 0
    asked = [tuple(x) for call in calls_in(tmp_path) for x in call]
    # twice collected, each distinct pair was scored once; no batch is larger than allowed, one model is built a worker
    assert sorted(map(repr, asked)) == sorted(map(repr, {r[1:] for r in rows})) and len(asked) == 14
    assert max(map(len, calls_in(tmp_path))) <= 4
    assert len(list(tmp_path.glob("built-*"))) <= len(list(tmp_path.glob("calls-*"))) + 4


def test_errors_stay_with_their_rows(spark, tmp_path):
    df = frame(spark, [(k, f"x{k}", "y") for k in range(40)], "id long, a string, b string").coalesce(1)
    got = hooks.scored(df, ["a", "b"], logged(tmp_path, fails=("x3", "x17")), "int", batch=16)
    good, bad = records.split_errors(got, "error")
    assert good.count() == 38 and {r.id for r in bad.collect()} == {3, 17}
    assert {(r.error.kind, r.value) for r in bad.collect()} == {("KeyError", None)}
    with pytest.raises(RuntimeError, match="2 rows failed"):
        records.raise_failures(bad, "id", "error")
    records.raise_failures(bad.where("id < 0"), "id", "error")


def test_too_few_values_are_an_error_of_the_rows():
    assert hooks.tried(lambda rows: [1], [("a",), ("b",)]) == [(1, None), (1, None)]
    (value, error), *_ = hooks.tried(lambda rows: [], [("a",), ("b",)])
    assert value is None and error["kind"] == "ValueError"


def iterative(spark, folder, version="v1", fail_at=None):
    """The iterative loop with calls noted by round; ``fail_at`` ends it in that round."""
    questions = frame(spark, [(1,), (2,), (3,), (4,)], "query long")
    context = [(1, c, "x") for c in range(3)] + [(2, 0, "x"), (3, 0, "noise")] + [(3, c, "x") for c in (1, 2, 3)]
    drawn_, found = [], []

    def draw(open_, own):
        drawn_.append(sorted(r.query for r in open_.collect()))
        if fail_at is not None and len(drawn_) > fail_at:
            raise ConnectionError("the model is gone")
        return drawn(spark)(open_, own)

    def retrieve(asked):
        found.append(sorted(r.query for r in asked.collect()))
        place = F.floor(F.rand(1) * 0) + 10 + F.lit(len(found))
        return asked.where("query <> 4").select("query", F.xxhash64("query", place).alias("chunk"), F.lit("found").alias("text"))

    progress = None if folder is None else Progress(spark, folder, version)
    steps, last = loops.iterate(
        questions, frame(spark, context, TEXT), draw, retrieve, lambda asked, own: own.where("text not like '%noise%'"),
        loops.Policy(rounds=4, fixed=(0.5, 0.5), patience=3), progress,
    )
    rows = sorted((r.query, r.iteration, r.se, r.decision) for r in steps.collect())
    sizes = {r.query: r["count"] for r in last.groupBy("query").count().collect()}
    return rows, sizes, drawn_


def test_loop_goes_on_after_the_last_committed_round(spark, tmp_path):
    want, sizes, _ = iterative(spark, None)
    folder = f"file://{tmp_path}/progress"
    with pytest.raises(ConnectionError):
        iterative(spark, folder, fail_at=2)
    rows, again, calls = iterative(spark, folder)
    assert rows == want and again == sizes
    assert calls[0] == [2, 4] and len(calls) == 2  # the third round and the fourth; no call for the first two
    rows, again, calls = iterative(spark, folder)
    assert rows == want and again == sizes and calls == []
    with pytest.raises(ValueError, match="version v1, not v2"):
        Progress(spark, folder, "v2")


def active(spark, folder, fail_at=None, finish=None, rounds=4):
    questions = frame(spark, [(1, "where"), (2, "who"), (3, "what")], "query long, question string")
    made = []

    def retrieve(asked):
        return asked.select("query", F.lit(1).cast("long").alias("chunk"), F.col("text"))

    def generate(open_, context):
        if fail_at is not None and len(made) >= fail_at:
            raise ConnectionError("the model is gone")
        made.append(sorted(r.query for r in open_.collect()))
        said = F.when(F.col("query") == 2, "The answer is Ada. And more text.").otherwise(" More is known.\nYet another one.")
        pieces = F.regexp_extract_all(said, F.lit(r"\s*\S+"), F.lit(0))
        # the piece after the first sentence is unsure, which must not count
        logs = F.transform(pieces, lambda p: F.when(p.contains("And") | p.contains("Yet"), -9.0).otherwise(0.0))
        return open_.select("query", said.alias("text"), pieces.alias("pieces"), logs.alias("logprobs"))

    progress = None if folder is None else Progress(spark, folder, "a")
    got = loops.active_retrieval(questions, generate, retrieve, 0.4, 0.4, rounds, finish, progress)
    return {r.query: (r.answer, r.steps, r.retrievals, r.reason) for r in got.collect()}, made


def test_active_retrieval_cuts_to_a_sentence_and_finishes(spark, tmp_path):
    asked = []

    def finish(ended, context):
        asked.append(sorted(r.query for r in ended.collect()))
        return ended.select("query", F.lit("So the answer is nothing.").alias("text"))

    got, _ = active(spark, None, finish=finish, rounds=2)
    assert got[2] == ("The answer is Ada.", 1, 1, "final_answer")
    assert got[1] == ("More is known. More is known. So the answer is nothing.", 2, 1, "max_rounds")
    assert asked == [[], [1, 3]]
    want, _ = active(spark, None)
    folder = f"file://{tmp_path}/active"
    with pytest.raises(ConnectionError):
        active(spark, folder, fail_at=3)
    got, made = active(spark, folder)
    assert got == want and all(q == [1, 3] for q in made if q)


def test_places_in_order_without_one_task(spark):
    rows = frame(spark, [(k * 7919 % 1000, f"t{k % 3}") for k in range(1000)], "id long, kind string").repartition(7)
    got = {r.id: r.place for r in slices.numbered(rows, "id").collect()}
    assert got == {k: k for k in range(1000)}
    down = [r.id for r in slices.sliced(rows, F.col("id").desc(), offset=10, size=90, where=F.col("kind") == "t1", limit=5).collect()]
    every = sorted(((r.id, r.kind) for r in rows.collect()), reverse=True)[10:100]
    assert sorted(down, reverse=True) == [i for i, kind in every if kind == "t1"][:5]
    assert slices.sliced(rows.limit(0), "id", offset=3).count() == 0
    assert slices.sliced(rows, "id", offset=2000).count() == 0
    plan = slices.numbered(rows, "id")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_lines_are_numbered_over_splits_smaller_than_a_file(spark, tmp_path):
    for name, n in (("a.jsonl", 400), ("b.jsonl", 3), ("c.jsonl", 150)):
        lines = ['{"id": %d, "text": "%s"}' % (k, "x" * (k % 37)) if k % 10 else "" for k in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = records.numbered_lines(spark, str(tmp_path)).collect()
        assert len(lines) == 553 and len({(r.file, r.line) for r in lines}) == 553
        read = records.read_numbered_json(spark, str(tmp_path), "id long, text string").collect()
        assert all(r.line == r.id for r in read) and len(read) == 400 - 40 + 3 + 150 - 15
        old = (tmp_path / "a.jsonl").read_text().split("\n")
        old[256], old[300] = '{"id": 257, "text": ', '{"id": "many"}'
        (tmp_path / "a.jsonl").write_text("\n".join(old))
        with pytest.raises(ValueError, match=r"2 malformed lines, of them a.jsonl:257, a.jsonl:301"):
            records.read_numbered_json(spark, str(tmp_path), "id long, text string")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
