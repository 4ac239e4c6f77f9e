"""Operator 6: language-model scores by a probabilistic suffix tree.

The model reads the bytes of a text in UTF-8, A-Z lower-cased, up to a final edge; no script is favoured. A byte's
distribution depends on the longest retained context among the ``DEPTH`` bytes before it, edges before the text included.
A context is retained where its bytes diverge from those of its next shorter one by more than the extra parameters are
worth (a likelihood-ratio test with an AIC penalty); every context that passes is kept, so the tree grows with the corpus.
Distributions are smoothed by Witten-Bell into the next shorter retained context, down to the uniform one. Counts are of
all training texts.

The tree is never in one place. Grams (a byte and the ``DEPTH`` before it) are counted over all tasks; the contexts of up
to two bytes are a few rows, and all longer ones that end in the same three bytes come to one task, which tests and smooths
them and gives each gram its cost. The most frequent grams and words, at most ``MOST_HOT_GRAMS`` and ``MOST_HOT``, go to
every task that scores; what else a text holds is joined with its cost by key and summed by text.

Training texts are those whose crc32 of doc_id (as text; empty for null) mod 5 is not 1. A null or empty text is its end
alone. Repeated rows are scored each for itself. Without training texts the model is uniform; an empty table gives no
rows. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.common import read, slices, written

#: Bytes of context; grams and words that every task knows at most.
DEPTH, MOST_HOT_GRAMS, MOST_HOT = 5, 1_000_000, 100_000
#: Distinct words that a task counts before it hands them on.
MOST_COUNTED = 300_000
#: Rows of short contexts that are broadcast at most; more are joined.
MOST_BROADCAST = 500_000
#: Numbers of bytes, and of a text's edge, which is no byte of UTF-8.
SIZE, EDGE = 256, b"\xff"
#: Grams with their costs come to a task in groups of this many at least.
TOGETHER = 200_000


def bytes_of(text: str | None) -> bytes:
    """A text's bytes; bytes.lower() knows ASCII letters only."""
    return (text or "").encode("utf-8", "replace").lower()


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and final edge, the number of it and the DEPTH bytes before it; and each text's first place."""
    edge = EDGE * DEPTH
    # an edge of DEPTH bytes before each text; the first byte of the next one is its own final edge
    letters = np.frombuffer(edge + edge.join(texts) + EDGE, np.uint8).astype(np.int64)
    code = letters[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        code += letters[DEPTH - back : len(letters) - back] << (8 * back)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    live = np.ones(len(code), bool)
    for back in range(1, DEPTH):
        live[(first[1:] - back)] = False
    starts = np.cumsum(sizes + 1) - sizes - 1
    return code[live], starts


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; bytes.split() knows ASCII white space only."""
    return bytes_of(text).split()


def is_held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


# -- counts -----------------------------------------------------------------------------------------------------------


class _Grams:
    """Counts of grams, in training texts and in all, merged as they come."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, codes: np.ndarray, training: bool) -> None:
        names, n = np.unique(codes, return_counts=True)
        self.held.append((names, n * training, n))
        self.size += len(names)
        if self.size > 1_500_000:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([c for c, *_ in self.held]), return_inverse=True)
        sums = (np.bincount(inverse, np.concatenate([h[k] for h in self.held])).astype(np.int64) for k in (1, 2))
        return codes, *sums


COUNTED = "word string, gram long, n long, times long"


def _counted(batches):
    """(held_out, text) to (word, null, n, times) and (null, gram, n, times) of a task; n counts training texts only."""
    words: Counter[bytes] = Counter()
    held_words: Counter[bytes] = Counter()
    grams = _Grams()

    def word_rows():
        names = [*words, *(w for w in held_words if w not in words)]
        n = np.array([words.get(w, 0) for w in names], np.int64)
        times = n + np.array([held_words.get(w, 0) for w in names], np.int64)
        words.clear()
        held_words.clear()
        for at in range(0, len(names), 20_000):
            some = pa.array(names[at : at + 20_000], pa.string())
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"word": some, "gram": none, "n": n[at : at + 20_000], "times": times[at : at + 20_000]}
            )

    def gram_rows():
        codes, n, times = grams.merged()
        grams.__init__()
        for at in range(0, len(codes), 100_000):
            some = slice(at, at + 100_000)
            none = pa.nulls(len(codes[some]), pa.string())
            yield pa.RecordBatch.from_pydict({"word": none, "gram": codes[some], "n": n[some], "times": times[some]})

    for batch in batches:
        for at, texts in slices(batch.column("text")):
            held_out = batch.column("held_out").slice(at, len(texts)).to_pylist()
            for training, into in ((True, words), (False, held_words)):
                own = [bytes_of(t) for t, held in zip(texts, held_out) if held != training]
                if own:
                    for text in own:
                        into.update(text.split())
                    into[b""] += len(own)
                    grams.add(grams_of(own)[0], training)
            if len(words) + len(held_words) > MOST_COUNTED:
                yield from word_rows()
            if grams.size > 1_000_000 and len(grams.held) == 1:
                yield from gram_rows()
    yield from word_rows()
    if grams.held:
        yield from gram_rows()


def counts(docs: DataFrame) -> DataFrame:
    """(word, gram, n, times), one of word and gram being null: its number in training texts and in all. The empty word is
    the end."""
    rows = docs.select(is_held_out().alias("held_out"), "text").mapInArrow(_counted, COUNTED)
    # a task has counted its own already: what is left is to bring equal keys together
    rows = rows.repartition("word", "gram")
    return rows.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


# -- the tree ---------------------------------------------------------------------------------------------------------


def level(context: np.ndarray, n: np.ndarray, parent: np.ndarray, parent_n: np.ndarray, parent_total: np.ndarray):
    """One depth of the tree, a row for each context and byte: the byte's count there, its probability, count and all counts
    in the next shorter context. Returns its smoothed probability, its context's total, and whether that is retained."""
    order = np.argsort(context, kind="stable")
    starts = np.nonzero(np.append(True, np.diff(context[order]) != 0))[0]
    of = np.empty(len(context), np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
    seen = n > 0
    total, letters = np.bincount(of, n), np.bincount(of, seen)
    gain = np.zeros(len(n))
    at = np.nonzero(seen)[0]
    gain[at] = n[at] * np.log((n[at] / total[of[at]]) / (parent_n[at] / parent_total[at]))
    # twice the gain is the likelihood ratio: each byte of a context is a parameter that must earn its place
    kept = (np.bincount(of, gain) > letters)[of]
    total, letters = total[of], letters[of]
    smoothed = (n + letters * parent) / np.maximum(total + letters, 1)
    return np.where(kept, smoothed, parent), total, kept


@dataclass
class Short:
    """The contexts of one byte at most: counts and probabilities by context and byte."""

    n: np.ndarray
    p: np.ndarray
    retained: int


def short_contexts(pairs: list[tuple[int, int]]) -> Short:
    """From (byte before << 8 | byte, count): at most 65,536 rows."""
    n = np.zeros((SIZE, SIZE))
    for pair, count in pairs:
        n[pair // SIZE, pair % SIZE] = count
    alone, total, letters = n.sum(0), n.sum(), (n.sum(0) > 0).sum()
    p0 = (alone + letters / SIZE) / max(1, total + letters) if total else np.full(SIZE, 1 / SIZE)
    context = np.repeat(np.arange(SIZE), SIZE)
    over = np.full(SIZE * SIZE, max(1.0, total))
    p, _, kept = level(context, n.ravel(), np.tile(p0, SIZE), np.tile(np.maximum(alone, 1e-300), SIZE), over)
    return Short(n, p.reshape(SIZE, SIZE), int(kept.reshape(SIZE, SIZE)[:, 0].sum()))


SHORT = "short long, s_n double, s_total double, s_p double, s_kept boolean"
COSTS = "gram long, times long, cost double, retained int"


def _second(short: Short):
    """Groups of (gram of three bytes, n) that share the byte before to the contexts of two bytes."""

    def second(table: pa.Table) -> pa.Table:
        gram, n = table["short"].to_numpy(), table["n"].to_numpy().astype(float)
        one, byte = gram >> 8 & 255, gram & 255
        total = short.n[one].sum(1)
        p, own, kept = level(gram >> 8, n, short.p[one, byte], np.maximum(short.n[one, byte], 1e-300), np.maximum(total, 1))
        return pa.table({"short": gram, "s_n": n, "s_total": own, "s_p": p, "s_kept": kept})

    return second


def _long(batches):
    """Rows sorted by the last three bytes of their contexts to the cost of each gram, and how many contexts are retained."""

    def costs(table: pa.Table):
        gram, times = table["gram"].to_numpy(), table["times"].to_numpy()
        n, p, above, total = (table[c].to_numpy().astype(float) for c in ("n", "s_p", "s_n", "s_total"))
        retained = 0
        for depth in range(3, DEPTH + 1):
            code = gram & ((1 << 8 * (depth + 1)) - 1)
            rows, first, back = np.unique(code, return_index=True, return_inverse=True)
            own = np.bincount(back, n)
            p_own, t_own, kept = level(rows >> 8, own, p[first], np.maximum(above[first], 1e-300), np.maximum(total[first], 1))
            retained += len(np.unique(rows[kept] >> 8))
            p, above, total = p_own[back], own[back], t_own[back]
        for at in range(0, len(gram), 100_000):
            some = slice(at, at + 100_000)
            number = np.zeros(len(gram[some]), np.int32)
            number[:1] = retained if at == 0 else 0
            yield pa.RecordBatch.from_pydict(
                {"gram": gram[some], "times": times[some], "cost": np.log10(p[some]), "retained": number}
            )

    held, size, enough = [], 0, TOGETHER
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["suffix"].to_numpy()
            cut = int(np.nonzero(key != key[-1])[0].max(initial=-1)) + 1
            if cut:
                yield from costs(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
            size = len(table) - cut
            enough = max(TOGETHER, 2 * size)
    if size:
        yield from costs(pa.Table.from_batches(held).combine_chunks())


def grow(grams: DataFrame) -> tuple[DataFrame, int]:
    """The suffix tree of a table (gram, n, times), as the log10 probability of every gram's byte after its longest
    retained context: (gram, times, cost), written; and the number of retained contexts."""
    byte = F.col("gram").bitwiseAND
    pairs = grams.groupBy(byte(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n"))
    short = short_contexts([(r.pair, r.n) for r in pairs.collect()])  # 65,536 rows at most
    two = grams.groupBy(byte(F.lit(0xFFFFFF)).alias("short")).agg(F.sum("n").alias("n"))
    # at most 65,536 rows in a group
    two = two.withColumn("one", F.shiftright("short", 8).bitwiseAND(F.lit(255))).groupBy("one")
    two = written(two.applyInArrow(_second(short), SHORT), "short-contexts")
    size, retained = two.agg(
        F.count("*"), F.count_distinct(F.when(F.col("s_kept"), F.shiftright("short", 8)))
    ).first()
    rows = grams.withColumn("own_short", byte(F.lit(0xFFFFFF)))
    rows = rows.join(F.broadcast(two) if size <= MOST_BROADCAST else two, F.col("own_short") == F.col("short"))
    rows = rows.select(
        "gram", "n", "times", "s_n", "s_total", "s_p", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF)).alias("suffix")
    )
    rows = rows.repartition("suffix").sortWithinPartitions("suffix")
    costs = written(rows.mapInArrow(_long, COSTS), "costs")
    more = costs.agg(F.coalesce(F.sum("retained"), F.lit(0))).first()[0]
    return costs.select("gram", "times", "cost"), short.retained + retained + more


def most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows (times, ...) of the largest times: as many as there are above some number, ``most`` at most."""
    step = F.floor(F.log2(F.col("times").cast("double")) * 16).cast("int")
    # a few hundred rows: one for each sixteenth of a power of two
    sizes = sorted((r.step, r.n) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect())
    least, found = math.inf, 0
    for at, n in reversed(sizes):
        if (found := found + n) > most:
            break
        least = at
    return rows.where(step >= least) if sizes and least < math.inf else rows.limit(0)


@dataclass
class Hot:
    """What every task knows: the costs of the most frequent grams, sorted, and words."""

    grams: np.ndarray
    costs: np.ndarray
    words: dict[bytes, float]
    unseen: float  # what a word costs that no training text has
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """A worker's view of the hot grams: most stand in a table by hash, all can be searched."""

    SLOTS = 22

    def __init__(self, hot: Hot):
        self.hot, self.words = hot, hot.words
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.costs = np.zeros(1 << self.SLOTS)
        slots = self.slots(hot.grams)
        self.keys[slots], self.costs[slots] = hot.grams, hot.costs

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).view(np.int64)

    def scores(self, texts: list[bytes]):
        """What hot grams give to the score of each text; and of each other gram the text's place, it, and how often."""
        codes, starts = grams_of(texts)
        slots = self.slots(codes)
        costs = self.costs[slots]
        other = np.nonzero(self.keys[slots] != codes)[0]
        if len(other) and len(self.hot.grams):
            at = np.minimum(np.searchsorted(self.hot.grams, codes[other]), len(self.hot.grams) - 1)
            known = self.hot.grams[at] == codes[other]
            costs[other[known]] = self.hot.costs[at[known]]
            other = other[~known]
        costs[other] = 0
        which = np.searchsorted(starts, other, "right") - 1
        names, back, n = np.unique(codes[other], return_inverse=True, return_counts=True)
        pairs, times = np.unique(which * len(names) + back, return_counts=True) if len(other) else (other, other)
        where, gram = (pairs // len(names), names[pairs % len(names)]) if len(other) else (other, other)
        return np.add.reduceat(costs, starts), where, gram, times


_HELD: list[tuple[str, Scorer]] = []


def _scorer(hot: Hot) -> Scorer:
    if not _HELD or _HELD[0][0] != hot.name:
        _HELD[:] = [(hot.name, Scorer(hot))]
    return _HELD[0][1]


PARTS = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word string, gram long, n long"
)


def _scored(model):
    """(doc_id, held_out, text) to a row for each text with what hot words and grams give, and one for each other of it."""

    def scored(batches):
        scorer, row = _scorer(model.value), TaskContext.get().partitionId() << 33
        unseen = scorer.hot.unseen
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                held = batch.column("held_out").slice(at, len(texts)).to_pylist()
                whole, rest, of, times = [], [], [], []
                raw, hot = [bytes_of(t) for t in texts], scorer.words
                scores, where, grams, gram_times = scorer.scores(raw)
                first = row
                for doc_id, held_out, text, score in zip(ids, held, raw, scores.tolist()):
                    words = text.split()
                    counts = Counter(words)
                    counts[b""] += 1
                    known, base = 0, 0.0
                    for word, n in counts.items():
                        cost = hot.get(word)
                        if cost is None:
                            rest.append(word)
                            of.append(row)
                            times.append(n)
                        else:
                            known += n if cost > unseen else 0
                            base += n * cost
                    whole.append((row, doc_id, held_out, len(words) + 1, known, base, score))
                    row += 1
                columns = list(zip(*whole))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                names = ("row", "doc_id", "held_out", "n_tokens", "known", "base", "score")
                yield _part({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})
                if rest:
                    yield _part({"row": pa.array(of, pa.int64()), "word": pa.array(rest, pa.string()), "n": pa.array(times, pa.int64())})
                for cut in range(0, len(where), 100_000):
                    some = slice(cut, cut + 100_000)
                    yield _part({"row": pa.array(first + where[some]), "gram": pa.array(grams[some]), "n": pa.array(gram_times[some])})

    return scored


PART_KINDS = {
    "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(),
    "base": pa.float64(), "score": pa.float64(), "word": pa.string(), "gram": pa.int64(), "n": pa.int64(),
}


def _part(given: dict) -> pa.RecordBatch:
    """A batch of all columns, null where not given."""
    size = len(given["row"])
    return pa.RecordBatch.from_pydict({n: given[n] if n in given else pa.nulls(size, k) for n, k in PART_KINDS.items()})


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    spark = docs.sparkSession
    counted = written(counts(docs), "counts")
    words = counted.where("word is not null").select("word", "n", "times")
    n_all, n_distinct = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.count_if(F.col("n") > 0), F.lit(0))
    ).first()
    below = math.log10(n_all + 0.5 * (n_distinct + 1))
    costs, _ = grow(counted.where("gram is not null").select("gram", "n", "times"))
    # at most MOST_HOT words and MOST_HOT_GRAMS grams: proven bounds
    top = most_frequent(words, MOST_HOT).select("word", "n").toArrow()
    word_costs = (np.log10(top["n"].to_numpy() + 0.5) - below).tolist()
    hot_words = dict(zip((w.encode("utf-8") for w in top["word"].to_pylist()), word_costs))
    top = most_frequent(costs, MOST_HOT_GRAMS).select("gram", "cost").toArrow()
    grams, order = top["gram"].to_numpy().astype(np.int64), np.argsort(top["gram"].to_numpy())
    hot = Hot(grams[order], top["cost"].to_numpy().astype(float)[order], hot_words, math.log10(0.5) - below + 1e-9)
    model = spark.sparkContext.broadcast(hot)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    parts = written(rows.mapInArrow(_scored(model), PARTS), "scored")
    # the hot keys are gone from the texts' side, so no key is frequent
    rest = parts.where("word is not null").select("row", "word", F.col("n").alias("of_text"))
    found = rest.join(words, "word").select(
        "row",
        F.when(F.col("n") > 0, F.col("of_text")).otherwise(0).alias("known"),
        (F.col("of_text") * (F.log10(F.col("n") + 0.5) - below)).alias("base"),
    )
    others = parts.where("gram is not null").select("row", "gram", F.col("n").alias("of_text")).join(costs, "gram")
    others = others.select("row", (F.col("of_text") * F.col("cost")).alias("score"))
    whole = parts.where("n_tokens is not null").select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score")
    both = whole.unionByName(found, allowMissingColumns=True).unionByName(others, allowMissingColumns=True)
    summed = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op6_suffixtree(spark, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return score(read(spark, sf_dir, "documents"))
