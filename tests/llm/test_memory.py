"""What steps hold in a worker and in an executor."""

import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import similar_groups
from veridelta.llm import byteids, common, pii, simhash, toxicity

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def own_batches(spark):
    """The session's batches as they were, after a test."""
    before = spark.conf.get(BATCH, None)
    spark.conf.unset(BATCH)
    yield
    spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def test_a_worker_keeps_things_of_one_step():
    path = byteids.vocabulary("byte_bpe_50k.json")
    encoder = byteids.byte_ids(path)
    encoder.encode(["some words to keep"])
    assert byteids.byte_ids(path) is encoder
    assert list(common.given_back(iter, keeps=True)([1])) == [1] and byteids.byte_ids(path) is encoder
    active = toxicity._active(toxicity.Ordinal({}, (1.0, 2.0)))
    assert toxicity._active(toxicity.Ordinal({}, (1.0, 2.0))) is active
    assert byteids.byte_ids(path) is not encoder  # it went for the other step's
    pii.find(pii.train(), ["call (303) 555-0177"])
    assert len(common._KEPT) == 1
    assert list(common.given_back(iter)([1])) == [1]
    assert not common._KEPT  # a step that keeps nothing has all of it dropped


def test_stages_hand_rows_to_workers_in_small_batches(spark, own_batches):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789"), 500).alias("text"))
    docs = spark.createDataFrame([(1, "one text")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        spark.conf.unset(BATCH)
        stage(spark, docs, "")
        assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 1.1 * common.BATCH_BYTES, name
    spark.conf.set(BATCH, "1m")  # what a session says itself stays
    common.small_batches(spark)
    assert spark.conf.get(BATCH) == "1m"


def test_shuffle_files_go_with_their_query(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}
    before, made = files(), []
    written = simhash.written

    def counted(df, name):
        out = written(df, name)
        made.append(df)  # else Spark may collect it
        return out

    monkeypatch.setattr(simhash, "written", counted)
    docs = spark.createDataFrame([(k, f"a few words of text {k % 7} and more") for k in range(40)], "doc_id long, text string").repartition(3)
    out = simhash.stage(spark, docs, "")
    time.sleep(1)
    assert made and not files() - before
    assert out.count() == 7
    spark.conf.set(name, False)  # what a session says itself stays
    common.short_shuffles(spark)
    assert spark.conf.get(name) == "false"
    spark.conf.unset(name)


def test_links_of_a_frequent_shingle_take_little_memory():
    # 1,000 sets in groups of ten with 95 of 100 in common, and one shingle in all
    draw = np.random.default_rng(5)
    sets, whole = [], np.arange(100, dtype=np.uint64)
    for k in range(1000):
        own = whole + np.uint64(1 + k // 10 * 1000)
        own[-5:] = draw.integers(1 << 40, 1 << 60, 5)
        sets.append(np.unique(np.append(own, np.uint64(0))))
    table = pa.table({"class": np.arange(1000), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    tracemalloc.start()
    got = simhash._hot_links(4, 5)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(got["a"].to_pylist(), got["b"].to_pylist())) == [(k, k // 10 * 10) for k in range(1000) if k % 10]
    assert peak < 24e6


def test_sets_that_meet_in_a_task_are_bounded_by_shingles(spark, monkeypatch):
    links, most = simhash._hot_links, 4000

    def watched(p, q):
        inner = links(p, q)

        def of(table):
            assert sum(len(x) for x in table["shingles"].to_pylist()) / 8 < 2 * most
            return inner(table)

        return of

    monkeypatch.setattr(simhash, "MOST_PAIRED", 4)
    monkeypatch.setattr(simhash, "MOST_SHINGLES", most)
    monkeypatch.setattr(simhash, "_hot_links", watched)
    # one run of five words in all texts, and near-copies of 50 others
    start = "one run of rare words"
    texts = [" ".join([start, *(f"w{k % 50}x{i}" for i in range(300)), *(f"own{k}x{i}" for i in range(20))]) for k in range(80)]
    texts = [t.split() for t in texts]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    signed = simhash.signatures(docs, 0.8)
    # as if the shared run were the rarest shingle of every set
    shared = int(simhash.shingle_hashes(start, 5).view(np.int64)[0])
    signed = signed.withColumn("prefix", F.array_union(F.array(F.lit(shared)), "prefix")).localCheckpoint()
    classes = signed.groupBy("class").agg(F.min("row").alias("row"), F.min("doc_id").alias("node")).localCheckpoint()
    none = spark.createDataFrame([], "a long, b long")
    node = {r["class"]: r.node for r in classes.collect()}
    found = simhash.near_links(docs, signed, classes, 0.8, none)
    pairs = {tuple(sorted((node[r.a], node[r.b]))) for r in found.collect()}
    least = similar_groups([" ".join(t) for t in texts])
    assert pairs == {(least[i], i) for i in range(len(texts)) if least[i] != i}
