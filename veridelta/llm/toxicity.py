"""Operator 5: toxicity severity by cumulative-link ordinal regression on sparse text features.

A text's severity grade is ordered: 0 none, 1 mild, 2 severe. One weight vector is shared by all thresholds:
P(grade > j) = sigmoid(w . x - theta_j), and the expected severity is the sum of those. Features are the words of the
text, lower-cased and stripped of punctuation, and their first 4 and 5 letters, each with weight log(1 + count).

It is fitted on a bounded sample of labelled rows: at most ``MOST_ROWS`` of each label, those least by a hash of their
id. A sampled row weighs as many as it stands for, all rows of its label by those sampled, so that what is learnt is the
share of toxic texts in the whole labels table, whatever its size. Labels say toxic or not. A toxic sample is severe if its
share of telling words is above the median of all; which words tell is learnt from the other half of the sample, never from
the text itself. Features are chosen in Spark by how many sampled texts hold them and how far those differ; at most
``MOST_FEATURES`` of them come to the driver, with the sampled texts' counts of them. The weights are kept sparse by an L1
penalty, so what is sent to the executors is bounded by ``MOST_WEIGHTS``.

Null and empty texts have no features and get the severity of a text without any; without labels of both kinds nothing
is learnt, and every text has severity 0. An id labelled both ways is toxic; an id whose rows repeat counts once, with its
least text. Rows without an id are scored, not learnt from; repeated rows are scored alike; an empty table gives no rows.
Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.common import kept, read, slices, small_batches, written

#: Labelled rows of each label that a model is fitted on at most, and weights it has at most.
MOST_ROWS, MOST_WEIGHTS = 3000, 20_000
#: Features that are looked at in the fit at most, and the least number of sampled texts that hold each.
MOST_FEATURES, LEAST_SEEN = 60_000, 3
#: A toxic text that stays costs as much as this many clean ones that go; so a text is rejected, and counts as of a grade,
#: where its chance of that grade or more is at least one in this and one.
COST = 4
REJECT_AT = 1 / (1 + COST)
GRADES = 3
#: Feature hashes kept per worker.
CACHE = 300_000
STRIP = re.compile(r"^\W+|\W+$")
SCHEMA = "expected_severity double, p_toxic double, grade int"


def features_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first letters."""
    word = STRIP.sub("", word.lower())
    if not word:
        return ()
    stems = {word, "4" + word[:4], "5" + word[:5]} if len(word) > 3 else {word}
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) for x in stems)


VECTORS = "toxic long, half int, features binary, counts binary, n_words long"


def _vectors(batches):
    """(toxic, half, text) to (toxic, half, features, counts, n_words)."""
    cache: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        for at, texts in slices(batch.column("text")):
            labels = batch.column("toxic").slice(at, len(texts))
            found = []
            for text in texts:
                count: Counter[int] = Counter()
                words = (text or "").split()
                for word, n in Counter(words).items():
                    if (fs := cache.get(word)) is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        fs = cache[word] = features_of(word)
                    for f in fs:
                        count[f] += n
                found.append((count, len(words)))
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": labels,
                    "half": batch.column("half").slice(at, len(texts)),
                    "features": [np.fromiter(c.keys(), np.uint32, len(c)).tobytes() for c, _ in found],
                    "counts": [np.fromiter(c.values(), np.float32, len(c)).tobytes() for c, _ in found],
                    "n_words": pa.array([n for _, n in found], pa.int64()),
                }
            )


def _held_by(times: tuple[float, float]):
    """Rows of ``VECTORS`` to the numbers of texts that hold each feature, in all and in each half; weighted ones too."""

    def held(batches):
        parts = []
        for batch in batches:
            for r in batch.to_pylist():
                names = np.frombuffer(r["features"], np.uint32)
                at = np.zeros((len(names), 5))
                at[:, 0], at[:, 1 + 2 * r["half"]] = 1, times[r["toxic"]]
                at[:, 2 + 2 * r["half"]] = times[r["toxic"]] * r["toxic"]
                parts.append((names, at))
        if parts:
            names, back = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
            sums = np.zeros((len(names), 5))
            np.add.at(sums, back, np.concatenate([x for _, x in parts]))
            columns = ("seen", "all_0", "bad_0", "all_1", "bad_1")
            yield pa.RecordBatch.from_pydict({"feature": names.astype(np.int64)} | dict(zip(columns, sums.T.copy())))

    return held


HELD = "feature long, seen double, all_0 double, bad_0 double, all_1 double, bad_1 double"


def _chosen(features: np.ndarray):
    """Rows of ``VECTORS`` with those of the sorted ``features`` only, by their places."""

    def chosen(batches):
        for batch in batches:
            rows = batch.to_pylist()
            places, counts = [], []
            for r in rows:
                names = np.frombuffer(r["features"], np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(features, names), max(0, len(features) - 1))
                own = features[at] == names if len(features) else np.zeros(len(names), bool)
                places.append(at[own].astype(np.int32).tobytes())
                counts.append(np.frombuffer(r["counts"], np.float32)[own].tobytes())
            kept = {n: batch.column(n) for n in ("toxic", "half", "n_words")}
            yield pa.RecordBatch.from_pydict(kept | {"features": places, "counts": counts}).select(batch.schema.names)

    return chosen


@dataclass
class Ordinal:
    """Shared weights by feature hash, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def above(self, counts: dict[int, int]) -> list[float]:
        """P(grade > j) for each threshold."""
        score = sum(self.weights[f] * np.log1p(n) for f, n in counts.items())
        return [float(1 / (1 + np.exp(-np.clip(score - t, -500, 500)))) for t in self.thresholds]


def fit_ordinal(rows, cols, values, grades, n_features, l1=2e-5, steps=600, rate=1.0, times=None):
    """Weights and thresholds by proximal gradient with momentum; numpy only, on bounded rows.

    A row counts as ``times`` rows, once by default."""
    n, k = len(grades), GRADES - 1
    times = np.ones(n) if times is None else np.asarray(times, float)
    share_of = times / times.sum()
    w, velocity = np.zeros(n_features), np.zeros(n_features)
    theta = np.array([np.log((times[grades <= j].sum() + 1) / (times[grades > j].sum() + 1)) for j in range(k)])
    share = np.bincount(cols, values**2 * share_of[rows], n_features)
    step = rate / np.sqrt(share + 1e-3)  # rare features move as fast as common ones
    for _ in range(steps):
        score = np.bincount(rows, values * w[cols], n)
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))  # P(grade > j)
        padded = np.column_stack([np.ones(n), above, np.zeros(n)])
        take = np.arange(n)
        mass = np.maximum(padded[take, grades] - padded[take, grades + 1], 1e-9)
        slope = padded * (1 - padded)
        by_score = -(slope[take, grades] - slope[take, grades + 1]) / mass * share_of
        by_theta = np.zeros(k)
        for j in range(k):
            by_theta[j] = (slope[:, j + 1] / mass * ((grades == j + 1).astype(float) - (grades == j)) * share_of).sum()
        gradient = np.bincount(cols, values * by_score[rows], n_features)
        velocity = 0.9 * velocity - 0.1 * step * gradient
        w = w + velocity
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * step * l1, 0)
        theta = np.sort(theta - 2.0 * by_theta)
    return w, theta


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Ordinal:
    """The model fitted on at most ``most_rows`` labelled texts of each label."""
    ids = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id")
    ids = ids.agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    # two rows at most
    of_label = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    by_hash = F.xxhash64("doc_id")
    picked = [ids.where(F.col("toxic") == v).orderBy(by_hash, "doc_id").limit(most_rows) for v in (0, 1)]
    # at most 2 * most_rows ids: a proven bound
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").where(F.col("text").isNotNull())
    # an id whose rows repeat counts once
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id")
    rows = rows.select("toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half"), "text")
    vectors = written(rows.mapInArrow(_vectors, VECTORS), "vectors")
    kinds = {r.toxic: r["count"] for r in vectors.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Ordinal({}, (30.0,) * (GRADES - 1))
    times = tuple(max(1.0, of_label.get(v, 0) / most_rows) for v in (0, 1))
    share = kinds[1] * times[1] / (kinds[0] * times[0] + kinds[1] * times[1])
    held = vectors.mapInArrow(_held_by(times), HELD)
    held = held.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("seen", "all_0", "bad_0", "all_1", "bad_1")])
    apart = F.abs((F.col("bad_0") + F.col("bad_1")) / (F.col("all_0") + F.col("all_1")) - share) * F.sqrt("seen")
    # features seen in one or two texts tell nothing
    held = held.where(F.col("seen") >= LEAST_SEEN).withColumn("apart", apart).where("apart >= 1")
    # at most MOST_FEATURES rows: a proven bound
    top = held.orderBy(F.col("apart").desc(), "feature").limit(MOST_FEATURES).toArrow().sort_by([("feature", "ascending")])
    names = top["feature"].to_numpy().astype(np.int64)
    # whether a feature tells, for the texts of one half by those of the other
    halves = [(top[f"all_{h}"].to_numpy(), top[f"bad_{h}"].to_numpy()) for h in (1, 0)]
    telling = np.array([bad > 0.9 * np.maximum(whole, 1e-9) for whole, bad in halves]).reshape(2, len(names))
    got = vectors.mapInArrow(_chosen(names), VECTORS).collect()  # 2 * most_rows texts, features chosen
    toxic, half = np.array([r.toxic for r in got], int), np.array([r.half for r in got], int)
    weight = np.array(times)[toxic]
    sizes = [len(r.features) // 4 for r in got]
    rows_at = np.repeat(np.arange(len(got)), sizes)
    cols = np.concatenate([np.frombuffer(r.features, np.int32) for r in got]).astype(int)
    counts = np.concatenate([np.frombuffer(r.counts, np.float32) for r in got]).astype(float)
    told = counts * telling[half[rows_at], cols]
    density = np.bincount(rows_at, told, len(got)) / np.maximum([r.n_words for r in got], 1)
    grades = np.where(toxic == 1, 1 + (density > np.median(density[toxic == 1])), 0)
    w, theta = fit_ordinal(rows_at, cols, np.log1p(counts), grades, len(names), times=weight)
    strongest = np.argsort(-np.abs(w), kind="stable")[:MOST_WEIGHTS]
    weights = {int(names[i]): float(w[i]) for i in sorted(strongest) if w[i]}
    return Ordinal(weights, tuple(float(t) for t in theta))


def severity(model: Ordinal, column: str | Column) -> Column:
    """A struct of expected_severity, p_toxic and grade for each whole text."""

    @F.pandas_udf(SCHEMA)
    def scored(texts: pd.Series) -> pd.DataFrame:
        out, active = [], _active(model)
        for text in texts:
            counts: Counter[int] = Counter()
            for fs in filter(None, map(active.__getitem__, (text or "").split())):
                counts.update(fs)
            above = model.above(counts)
            out.append((sum(above), above[0], sum(p >= REJECT_AT for p in above)))
        return pd.DataFrame(out, columns=["expected_severity", "p_toxic", "grade"])

    return scored(column)


class _Active(dict):
    """Word to those of its features that have a weight; words are looked up once."""

    def __init__(self, model: Ordinal):
        super().__init__()
        self.weights = model.weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found


def _active(model: Ordinal) -> _Active:
    """This worker's lookups for ``model``."""
    held: list[tuple[Ordinal, _Active]] = kept("words' active features", list)
    if not held or (held[0][0] is not model and held[0][0] != model):
        held[:] = [(model, _Active(model))]
    return held[0][1]


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of every document, and whether it is rejected."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", severity(model, "text").alias("s")).select("doc_id", "s.*")
    return scored.withColumn("rejected", F.col("p_toxic") >= REJECT_AT)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't rejected, columns as they were.

    The model is fitted on the labelled rows of the whole ``documents`` table, which ``docs`` is at this stage."""
    small_batches(spark)
    return stage_of(docs, train(docs, read(spark, sf_dir, "labels")))


def stage_of(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The documents that ``model`` doesn't reject."""
    return docs.where(severity(model, "text")["p_toxic"] < REJECT_AT)
