"""Operator 8: SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits; bit i is set if more than half of the hashes of its word shingles have it set. Texts
link where their fingerprints differ in at most ``tau`` bits. To find the links, the 64 bits are grouped into partitions
of correlated bits, and each partition gets its own threshold, unequal ones allowed, with sum tau - m + 1: two
fingerprints within tau must then be within the threshold of at least one partition. The thresholds (and the number of
partitions) are those of least estimated cost, found by dynamic programming over counts of all fingerprints' partition
values. Each fingerprint is filed under its value in each partition and probes the values within the threshold; what
meets is verified. Every step runs on distinct fingerprints, so copies cost nothing, and what a task emits is a spanning
set of its verified links, never all pairs.

A value that holds very many fingerprints is not compared in one task: for small tau its members are filed anew under
one of tau + 1 parts of their other bits, one of which must agree (exact, and bounded as fingerprints are distinct); what
is still too large is dealt into blocks, and each pair of blocks meets in its own task.

The pipeline's stage links copies by fingerprints within two bits, each link checked on the whole sets of distinct five-word
shingles. Near-copies that end early or have text added differ in more bits than can be probed for, so an exact way for the
rest follows: a prefix filter over the pairs that aren't connected yet, as a similar pair shares one of its rarest shingles.
The few pairs that meet at a shingle are first held against their histograms (an upper bound of what two sets share), then
compared on the whole sets. Where many texts hold a shingle, their sizes, places and histograms meet in blocks, in rounds: each
text that may be similar to one of another component proposes a few such pairs, which are compared on the whole sets and
connect components for the next round. Whole sets meet in blocks only where very many pairs are left after the last round, and
spanning links leave each block. No pair at the threshold is lost.

Null and empty texts have fingerprint zero, linked like any other. Rows with null ids are fingerprinted and link, but name
no component unless no row of it has an id. Repeated rows share a fingerprint and a component. Texts of any length are read
whole; an empty table gives no rows; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.common import _give_back, checkpointed, given_back, read, short_shuffles, slices, small_batches, written
from veridelta.operators.components import connected_components

SEED = 42
#: Members of one partition value that one task compares.
MOST_TOGETHER = 4096
#: Seconds that filing one row and comparing one pair take, for the estimate; only their ratio matters.
FILE_S, PAIR_S = 2e-6, 4e-9
#: Numbers of partitions that are tried.
PARTITIONS = (2, 3, 4, 6, 8, 12)
#: Classes of a rare shingle whose pairs are looked at one by one, and classes with whole sets in one task.
MOST_PAIRED, MOST_COMPARED = 32, 1024
#: Shingles, on average, of the classes with whole sets in one task; longer sets meet in more blocks.
MOST_SHINGLES = 1 << 20
#: Of those, the rows of their matrix of pairs that are looked at together.
ROWS_AT_ONCE = 128
#: Rounds in which the classes of a frequent shingle propose pairs, and how many each proposes. A task with at most so many
#: pairs for each of its classes hands them all out, and after the last round with at most so many.
ROUNDS, PROPOSED, FEW, FEW_LAST = 4, 4, 4, 16
#: Bins of a set's histogram.
BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Ids that are broadcast at most; more are joined.
MOST_BROADCAST = 500_000
#: The shingle length of near-copies, and the share of shingles that they have in common.
NEAR_WORDS, NEAR = 5, 0.8
#: Documents that are sampled for frequent shingles, or one in so many if that is more; what counts as frequent there, and
#: how many of those every task knows.
MOST_SAMPLED, LEAST_SHARE, LEAST_COMMON, MOST_COMMON = 20_000, 64, 3, 500_000


# -- fingerprints -----------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    # bytes.lower() and bytes.split() know ASCII letters and white space only
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([hashed(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    n = len(found) - words + 1
    spans = zip(starts[:n], ends[words - 1 :])
    return np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in spans), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64 majority bits, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(column: str | Column, words: int = 3) -> Column:
    """The fingerprint of each whole text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(shingle_hashes(t or "", words)) for t in texts], dtype="int64")

    return of(column)


# -- partitions and thresholds ----------------------------------------------------------------------------------------


def _long(bits: int) -> int:
    """Unsigned bits as a signed long."""
    return bits - (1 << 64) if bits >> 63 else bits


def correlations(codes: DataFrame) -> np.ndarray:
    """The absolute correlation of every two bits over all fingerprints."""

    def counts(batches):
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            raw = batch.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(64)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": both[i, j].astype(np.int64), "of": np.full(len(i), n)}
            )

    rows = codes.select("fp").mapInArrow(counts, "i int, j int, n long, of long")
    both, n = np.zeros((64, 64)), 1
    for r in rows.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("of").alias("of")).collect():
        both[r.i, r.j] = both[r.j, r.i] = r.n
        n = r["of"]
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size, each grown by the bit most correlated with it."""
    free, groups = set(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(sorted(free), key=lambda i: sum(correlation[i, j] for j in free if j != i))]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda i: correlation[i, group].mean())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(tau: int, cost: list[list[float]]) -> tuple[float, list[int]]:
    """Thresholds, -1 or more, with sum tau - m + 1 and least total cost; ``cost[i][t + 1]`` is partition i's at t."""
    m = len(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, own in enumerate(cost[i], -1):
                at = used + t
                if at not in step or c + own < step[at][0]:
                    step[at] = (c + own, [*ts, t])
        best = step
    return best.get(tau - m + 1, (math.inf, []))


def plan(codes: DataFrame, tau: int) -> list[tuple[int, list[int]]]:
    """(mask, flips) of each partition used: a fingerprint is filed under ``fp & mask ^ flip`` for every flip."""
    correlation = correlations(codes)
    tried = {m: grouped_bits(correlation, m) for m in PARTITIONS if m <= tau + 2}
    masks = [(m, i, sum(1 << b for b in bits)) for m, groups in tried.items() for i, bits in enumerate(groups)]
    named = F.explode(F.array(*[F.struct(F.lit(m * 100 + i).alias("p"), F.lit(_long(x)).alias("mask")) for m, i, x in masks]))
    values = codes.select("fp", named.alias("part")).groupBy("part.p", F.col("fp").bitwiseAND(F.col("part.mask")).alias("v"))
    sizes = values.count().groupBy("p").agg(
        F.sum(F.col("count").cast("double") * F.least(F.col("count"), F.lit(MOST_TOGETHER))).alias("pairs"),
        F.sum("count").alias("n"),
    )
    counted = {r.p: (r.pairs, r.n) for r in sizes.collect()}
    best = (math.inf, [], [])
    for m, groups in tried.items():
        cost = []
        for i, bits in enumerate(groups):
            pairs, n = counted.get(m * 100 + i, (0.0, 0))
            own = [0.0]
            for t in range(0, 3):
                probes = sum(math.comb(len(bits), r) for r in range(t + 1))
                # a value and its neighbours are at most as full together as so many of the value itself
                own.append(n * probes * FILE_S + pairs * probes * PAIR_S if probes <= 300 else math.inf)
            cost.append(own)
        total, thresholds = allocate(tau, cost)
        if total < best[0]:
            best = (total, groups, thresholds)
    out = []
    for bits, t in zip(best[1], best[2]):
        if t >= 0:
            flips = [sum(1 << b for b in c) for r in range(t + 1) for c in itertools.combinations(bits, r)]
            out.append((_long(sum(1 << b for b in bits)), [_long(f) for f in flips]))
    return out


# -- probing and verifying --------------------------------------------------------------------------------------------


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _near(fps: np.ndarray, starts: np.ndarray, tau: int):
    """Index pairs within tau bits inside each group; groups are runs that begin at ``starts``."""
    n = len(fps)
    ends = np.append(starts[1:], n)
    end_of = np.repeat(ends, ends - starts)
    found_i, found_j = [], []
    small = np.repeat(ends - starts <= 64, ends - starts)
    live, d = np.nonzero(small)[0], 1
    while len(live):
        live = live[live + d < end_of[live]]
        hit = live[np.bitwise_count(fps[live] ^ fps[live + d]) <= tau]
        found_i.append(hit)
        found_j.append(hit + d)
        d += 1
    for a, b in zip(starts, ends):
        if b - a > 64:
            for at in range(a, b, 256):
                rows = fps[at : min(at + 256, b)]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ fps[None, at:b]) <= tau)
                keep = i < j
                found_i.append(at + i[keep])
                found_j.append(at + j[keep])
    return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


def _verify(tau: int):
    """Rows sorted by key to the spanning links of each key's members; a key is held whole, no more."""

    def links(table: pa.Table):
        keys = [table[n].to_numpy() for n in ("mask", "value", "block")]
        fps, nodes = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
        new = np.ones(len(fps), bool)
        if len(fps) > 1:
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        i, j = _near(fps, np.nonzero(new)[0], tau)
        label = _labels(len(fps), i, j)
        other = np.nonzero((label != np.arange(len(fps))) & (nodes[label] != nodes))[0]
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(nodes[other], pa.int64()), "b": pa.array(nodes[label[other]], pa.int64())}
        )

    def verify(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            last = [table[n].to_numpy() for n in ("mask", "value", "block")]
            same = np.logical_and.reduce([k == k[-1] for k in last])
            cut = int(np.nonzero(~same)[0].max(initial=-1)) + 1
            if cut:
                yield links(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None:
            yield links(held.combine_chunks())

    return verify


def links(codes: DataFrame, tau: int) -> DataFrame:
    """(a, b): links that connect what all pairs of ``codes`` (node long, fp long) within tau bits connect."""
    parts = plan(codes, tau)
    columns = ["node", "fp"]
    filed = F.explode(
        F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(f).alias("flip")) for m, flips in parts for f in flips])
    )
    rows = codes.select(*columns, filed.alias("k")).select(
        *columns,
        F.col("k.mask").alias("mask"),
        F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("value"),
    )
    key = ["mask", "value"]
    cold = []
    while True:
        full = rows.groupBy(*key).count().where(F.col("count") > MOST_TOGETHER)
        full = checkpointed(full)
        if full.isEmpty():
            break
        cold.append(rows.join(full, key, "left_anti"))
        hot = rows.join(full.drop("count"), key, "left_semi")
        masks = [r.mask for r in full.select("mask").distinct().collect()]  # a few partitions' masks
        free = {m: [b for b in range(64) if not (m >> b) & 1] for m in masks}
        if tau > 3 or any(len(bits) <= tau for bits in free.values()):
            # dealt into blocks, each pair of which meets once
            sized = rows.join(full, key)
            n = F.ceil(F.col("count") * 2 / MOST_TOGETHER).cast("int")
            sized = sized.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
            other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
            sized = sized.select("*", other)
            block = F.least("own", "other") * F.lit(1 << 20).cast("long") + F.greatest("own", "other") + 1
            cold.append(sized.withColumn("block", block).select(*columns, *key, "block"))
            rows = None
            break
        # a part of the other bits must agree too
        finer = F.lit(None).cast("array<long>")
        for mask, bits in free.items():
            own = [_long(sum(1 << b for b in bits[k :: tau + 1])) for k in range(tau + 1)]
            finer = F.when(F.col("mask") == mask, F.array(*map(F.lit, own))).otherwise(finer)
        rows = hot.select(*columns, *key, F.explode(finer).alias("more")).select(
            *columns,
            F.col("mask").bitwiseOR(F.col("more")).alias("mask"),
            F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.col("more"))).alias("value"),
        )
    if rows is not None:
        cold.append(rows)
    whole = None
    for part in cold:
        part = part if "block" in part.columns else part.withColumn("block", F.lit(0).cast("long"))
        part = part.select(*columns, *key, "block")
        whole = part if whole is None else whole.unionByName(part)
    sorted_rows = whole.repartition(*key, "block").sortWithinPartitions(*key, "block", "fp", "node")
    return sorted_rows.mapInArrow(given_back(_verify(tau)), "a long, b long").distinct()


def components(prints: DataFrame, tau: int = 2) -> DataFrame:
    """``prints`` (doc_id long, fp long) with component_id, the least doc_id reachable over links."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(distinct.select(F.col("fp").alias("node"), "fp"), tau), "a", "b")
    members = distinct.join(found, distinct.fp == found.node).select("fp", "rep", "component")
    named = members.groupBy("component").agg(F.min("rep").alias("least"))
    moved = members.join(named, "component").select("fp", "least")
    rooted = distinct.join(moved, "fp", "left").select(
        F.col("fp").alias("own_fp"), F.coalesce("least", "rep").alias("component_id")
    )
    # kept by itself, so that a fingerprint with very many copies can be split in the join
    rooted = checkpointed(rooted)
    return prints.join(rooted, prints.fp == rooted.own_fp).select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = read(spark, sf_dir, "documents")
    prints = written(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    found = components(prints, tau=2)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


# -- near-copies ------------------------------------------------------------------------------------------------------


def _ratio(near: float) -> tuple[int, int]:
    """``near`` as a fraction p / q, so that sizes are compared in whole numbers."""
    exact = Fraction(near).limit_denominator(10_000)
    return exact.numerator, exact.denominator


def _shingles(text: str | None) -> np.ndarray:
    """The distinct five-word shingles of a text, sorted."""
    return np.unique(shingle_hashes(text or "", NEAR_WORDS))


def _class_of(shingles: np.ndarray) -> int:
    """A number for a set of shingles."""
    return _long(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def _histogram(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of ``BINS`` bins. Two sets share at most the sum of the lesser counts."""
    return np.bincount((shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64), minlength=BINS).astype("<u2").tobytes()


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of ``docs``, sorted, and their counts there; ``MOST_COMMON`` at most.

    They only put shingles in an order. Every order finds the same pairs, so a sample will do."""

    def counts(batches):
        for batch in batches:
            for _, texts in slices(batch.column("text"), 2048):
                found = np.concatenate([_shingles(t) for t in texts])
                names, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": names.view(np.int64), "n": n.astype(np.int64)})

    every = min(LEAST_SHARE, max(1, docs.count() // MOST_SAMPLED))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counted = some.mapInArrow(given_back(counts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # at most MOST_COMMON rows: a proven bound
    top = counted.where(F.col("n") >= LEAST_COMMON).orderBy(F.col("n").desc(), "key").limit(MOST_COMMON).toArrow()
    names, n = top["key"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(names)
    return names[order], n[order]


def _prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], p: int, q: int) -> np.ndarray:
    """The rarest of a sorted set of shingles, one of which every set similar by p / q or more has among its rarest."""
    size = len(shingles)
    if not size:
        return shingles
    names, counts = common
    if len(names):
        at = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        known = np.where(names[at] == shingles, counts[at], 0)
        if known.any():
            shingles = shingles[np.argsort(known, kind="stable")]
    return shingles[: size + (-p * size // q) + 1]


SIGNATURES = "row long, doc_id long, class long, n int, prefix array<long>, histogram binary, fp long"


def signatures(docs: DataFrame, near: float) -> DataFrame:
    """For each of ``docs`` its row number, its class (of equal shingle sets), its number of shingles, the rarest of them,
    the histogram of all and the text's fingerprint, written."""
    p, q = _ratio(near)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def signed(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                sets = [_shingles(t) for t in texts]
                prefixes = [_prefix(s, common.value, p, q) for s in sets]
                ends = np.cumsum([0, *map(len, prefixes)])
                values = pa.array(np.concatenate(prefixes).view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": np.arange(row, row + len(texts)),
                        "doc_id": batch.column("doc_id").slice(at, len(texts)),
                        "class": pa.array([_class_of(s) for s in sets], pa.int64()),
                        "n": pa.array([len(s) for s in sets], pa.int32()),
                        "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                        # where a count needs more than 16 bits, there is none
                        "histogram": pa.array([_histogram(s) if len(s) < 1 << 16 else None for s in sets], pa.binary()),
                        "fp": pa.array([fingerprint_of(shingle_hashes(t or "", 3)) for t in texts], pa.int64()),
                    }
                )
                row += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(given_back(signed), SIGNATURES), "signatures")


MET = "a long, b long, key long, n long, pos long"


def _met(p: int, q: int):
    """Rows sorted by key and n to the pairs of classes that may be similar; the rows of a key with over ``MOST_PAIRED``
    classes go through, with no b but their sizes and places."""

    def pairs(table: pa.Table, starts: np.ndarray):
        classes, n, pos = (table[c].to_numpy() for c in ("class", "n", "pos"))
        ends = np.append(starts[1:], len(n))
        end_of = np.repeat(ends, ends - starts)
        left = n - pos  # shingles from the shared one on
        live, d, held = np.nonzero(end_of - np.arange(len(n)) > 1)[0], 1, []
        while len(live):
            live = live[live + d < end_of[live]]
            # sorted by n: what is too long stays so
            live = live[n[live + d] * p <= n[live] * q]
            need = -(-p * (n[live] + n[live + d]) // (p + q))
            hit = live[np.minimum(left[live], left[live + d]) >= need]
            if len(hit):
                held.append(np.sort(np.column_stack([classes[hit], classes[hit + d]]), axis=1))
            d += 1
        found = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.int64)
        for at in range(0, len(found), 100_000):
            a, b = found[at : at + 100_000].T
            none = pa.nulls(len(a), pa.int64())
            own = {"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b)}
            yield pa.RecordBatch.from_pydict(own | {"key": none, "n": none, "pos": none})

    def through(table: pa.Table):
        for batch in table.combine_chunks().to_batches():
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column("class"), "b": none} | {c: batch.column(c) for c in ("key", "n", "pos")})

    def groups(table: pa.Table):
        keys = table["key"].to_numpy()
        starts = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
        sizes = np.diff(np.append(starts, len(keys)))
        if (sizes > MOST_PAIRED).any():
            hot = np.repeat(sizes > MOST_PAIRED, sizes)
            yield from through(table.filter(pa.array(hot)))
            table, sizes = table.filter(pa.array(~hot)).combine_chunks(), sizes[sizes <= MOST_PAIRED]
            starts = np.cumsum(sizes) - sizes
        if len(table):
            yield from pairs(table, starts)

    def met(batches):
        held, passing = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if passing is not None:  # the rest of a key that goes through
                own = int((table["key"].to_numpy() == passing).sum())
                yield from through(table.slice(0, own))
                table = table.slice(own)
            if not len(table):
                continue
            passing = None
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            keys = table["key"].to_numpy()
            cut = int(np.nonzero(keys != keys[-1])[0].max(initial=-1)) + 1
            if cut:
                yield from groups(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
            if len(held) > MOST_PAIRED:
                passing = keys[-1]
                yield from through(held)
                held = None
        if held is not None:
            yield from groups(held.combine_chunks())

    return met


def _may_be_similar(p: int, q: int) -> Column:
    """Whether two sets can be similar by their histograms; true where one has none."""

    @F.pandas_udf("boolean")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        known = np.nonzero((a.notna() & b.notna()).to_numpy())[0]
        for at in range(0, len(known), 1024):
            own = known[at : at + 1024]
            x, y = (
                np.frombuffer(b"".join(s.iloc[own]), "<u2").astype(np.int64).reshape(-1, BINS) for s in (a, b)
            )
            out[own] = np.minimum(x, y).sum(1) * (p + q) >= (x.sum(1) + y.sum(1)) * p
        return pd.Series(out)

    return of("of_a", "of_b")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles) of the texts whose doc_id is a ``node`` of ``wanted``, written."""

    def sets(batches):
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                found = [_shingles(t) for t in texts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "class": pa.array([_class_of(s) for s in found], pa.int64()),
                        "shingles": pa.array([s.tobytes() for s in found], pa.binary()),
                    }
                )

    nodes = checkpointed(wanted.select("node").distinct())
    if nodes.count() <= MOST_BROADCAST:  # else a join that shuffles both sides
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    found = texts.select("text").mapInArrow(given_back(sets), "class long, shingles binary")
    # rows that share an id may be of a class that nobody asked for, or repeat one
    found = found.join(wanted.select("class"), "class", "left_semi")
    return written(found.groupBy("class").agg(F.max("shingles").alias("shingles")), "shingles")


def _similar(p: int, q: int) -> Column:
    """Whether two sets of shingles are similar, by their sorted bytes."""

    @F.pandas_udf("boolean")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            out.append(shared * (p + q) >= (len(x) + len(y)) * p)
        return pd.Series(out, dtype=bool)

    return of("of_a", "of_b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The number of elements that each two sets share, by products of 0/1 matrices of bounded width."""
    sizes = [len(s) for s in sets]
    names, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, twice = np.repeat(np.arange(len(sets)), sizes), seen > 1
    place = np.cumsum(twice) - 1
    use = twice[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 1024
    for at in range(0, int(twice.sum()), width):
        low, high = np.searchsorted(column, [at, at + width])
        holds = np.zeros((len(sets), width), np.float32)
        holds[row[low:high], column[low:high] - at] = 1
        out += holds @ holds.T
    out[np.arange(len(sets)), np.arange(len(sets))] = sizes
    return out.astype(np.int32)


def _hot_links(p: int, q: int):
    """The members of one key, or of a pair of its blocks, to links that connect what all its similar pairs connect."""

    def links(table: pa.Table) -> pa.Table:
        classes = table["class"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        sizes = np.array([len(s) for s in sets])
        shared, place = overlaps(sets), np.arange(len(sets))
        other = label = np.zeros(0, np.int64)
        for at in range(0, len(sets), ROWS_AT_ONCE):  # what is connected so far goes on as spanning links
            own = slice(at, at + ROWS_AT_ONCE)
            similar = shared[own].astype(np.int64) * (p + q) >= (sizes[own, None] + sizes) * p
            i, j = np.nonzero(similar & (place > place[own, None]))
            label = _labels(len(sets), np.concatenate([other, i + at]), np.concatenate([label[other], j]))
            other = np.nonzero(label != place)[0]
        return pa.table({"a": pa.array(classes[other], pa.int64()), "b": pa.array(classes[label[other]], pa.int64())})

    def given(table: pa.Table) -> pa.Table:
        try:
            return links(table)
        finally:
            _give_back()

    return given


PROPOSALS = "a long, b long, key long, one int, two int"


def _proposals(p: int, q: int, salts: list[int], last: bool):
    """The members of one key, or of a pair of its blocks, to pairs (a, b) of classes that may be similar and that no links
    connect yet: all, if they are few; else some for each class, and a row (key, one, two) that says that there are more, or
    in the ``last`` round the members (a, key, one, two) whose whole sets must meet."""

    def may_be_similar(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sizes, places, component = (table[c].to_numpy() for c in ("n", "pos", "component"))
        known = np.array([x.is_valid for x in table["histogram"]], bool)
        bins = np.zeros((len(sizes), BINS), np.int32)
        held = table["histogram"].drop_null().to_pylist()
        bins[known] = np.frombuffer(b"".join(held), "<u2").reshape(-1, BINS)
        # sets share nothing before a shingle that is the first one they share
        left, at_all = sizes - places, np.arange(len(sizes))
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(sizes), ROWS_AT_ONCE):
            own = slice(at, at + ROWS_AT_ONCE)
            enough = np.minimum(left[own, None], left) * (p + q) >= (sizes[own, None] + sizes) * p
            i, j = np.nonzero(enough & (component[own, None] != component) & (at_all > at_all[own, None]))
            i += at
            for some in range(0, len(i), 2048):
                x, y = i[some : some + 2048], j[some : some + 2048]
                most = np.minimum(bins[x], bins[y]).sum(1, dtype=np.int64)
                keep = (most * (p + q) >= (sizes[x] + sizes[y]) * p) | ~known[x] | ~known[y]
                found_i.append(x[keep])
                found_j.append(y[keep])
        return np.concatenate(found_i), np.concatenate(found_j)

    def proposed(table: pa.Table) -> pa.Table:
        classes = table["class"].to_numpy()
        i, j = may_be_similar(table)
        members = np.unique(np.concatenate([i, j]))
        few = len(i) <= len(members) * (FEW_LAST if last else FEW)
        if few:
            pairs = np.column_stack([classes[i], classes[j]])
        elif last:
            pairs = np.zeros((0, 2), np.int64)
        else:
            # each takes the first of its pairs' others, in an order of all classes for each salt: so keys with the same classes
            # propose the same pairs
            one, other, pairs = np.concatenate([i, j]), np.concatenate([j, i]), []
            for salt in salts:
                order = np.argsort((classes.view(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15))
                rank, first = np.empty(len(order), np.int64), np.full(len(order), len(order))
                rank[order] = np.arange(len(order))
                np.minimum.at(first, one, rank[other])
                pairs.append(np.column_stack([classes[members], classes[order[first[members]]]]))
            pairs = np.concatenate(pairs)
        a, b = np.unique(np.sort(pairs, axis=1), axis=0).T
        out = [{"a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b), **dict.fromkeys(("key", "one", "two"), pa.nulls(len(a), pa.int64()))}]
        if not few:
            more = classes[members] if last else pa.nulls(1, pa.int64())
            same = {c: pa.array([table[c][0].as_py()] * len(more), pa.int64()) for c in ("key", "one", "two")}
            out.append({"a": more, "b": pa.nulls(len(more), pa.int64()), **same})
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("one", pa.int32()), ("two", pa.int32())])
        return pa.concat_tables([pa.table({k: pa.array(v, pa.int64()) for k, v in x.items()}).cast(schema) for x in out])

    def given(table: pa.Table) -> pa.Table:
        try:
            return proposed(table)
        finally:
            _give_back()

    return given


def _ends(pairs: DataFrame) -> DataFrame:
    """(class): the classes of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()


def _confirmed(pairs: DataFrame, found: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets, in ``found``, are similar."""
    both = pairs.join(found.select(F.col("class").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.join(found.select(F.col("class").alias("b"), F.col("shingles").alias("of_b")), "b")
    return both.where(_similar(p, q)).select("a", "b")


def fingerprint_links(docs: DataFrame, rows: DataFrame, classes: DataFrame, near: float, tau: int = 2) -> DataFrame:
    """(a, b): classes that fingerprints within ``tau`` bits bring together and whose sets are similar by ``near`` or more.

    Distinct fingerprints are linked by the generalised pigeonhole principle; the classes of one meet its least class."""
    prints = written(rows.select("class", "fp").distinct(), "prints")
    heads = written(prints.groupBy("fp").agg(F.min("class").alias("head")), "heads")
    of = lambda c: heads.select(F.col("fp").alias(f"fp_{c}"), F.col("head").alias(c))
    linked = links(heads.select(F.col("fp").alias("node"), "fp"), tau).toDF("fp_a", "fp_b")
    met = linked.join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    met = met.unionByName(prints.join(heads, "fp").select(F.col("class").alias("a"), F.col("head").alias("b")))
    pairs = checkpointed(met.where("a <> b").distinct())
    found = _sets(docs, classes.select("class", "node").join(_ends(pairs), "class", "left_semi"))
    return checkpointed(_confirmed(pairs, found, *_ratio(near)))


def near_links(docs: DataFrame, rows: DataFrame, classes: DataFrame, near: float, known: DataFrame) -> DataFrame:
    """(a, b): links that, with those ``known``, connect what all pairs of classes that are similar by ``near`` or more connect.

    Pairs that known links connect already aren't looked at again. Sets that similar share one of their rarest shingles, and
    from the first shared one on both have enough left. Where a shingle has few classes, their pairs are looked at by size, place
    and histogram, then on the whole sets. Where it has many, the same is looked at in blocks of about ``MOST_COMPARED`` sets and
    ``MOST_SHINGLES`` shingles at most, in rounds, so that a class's whole set travels for its few proposed pairs and not for each
    of its shingles. What is left after the last round meets with whole sets, in the same blocks."""
    p, q = _ratio(near)
    prefixes = rows.select("row", "class", "n", "prefix").join(classes.select("row"), "row")
    keyed = prefixes.select("class", "n", F.posexplode("prefix").alias("pos", "key"))
    keyed = keyed.select("key", "class", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))
    keyed = keyed.repartition("key").sortWithinPartitions("key", "n")
    met = written(keyed.mapInArrow(given_back(_met(p, q)), MET), "met")

    joined = connected_components(known, "a", "b")
    of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    pairs = met.where("b is not null and a <> b").select("a", "b").distinct()
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = checkpointed(pairs.where("of_a is null or of_b is null or of_a <> of_b").select("a", "b"))
    hot = met.where("b is null").select("key", F.col("a").alias("class"), "n", "pos")
    held = classes.select("class", "row").join(_ends(pairs).unionByName(hot.select("class")), "class", "left_semi")
    held = written(held.join(rows.select("row", "histogram"), "row").select("class", "histogram"), "histograms")
    both = pairs.join(held.select(F.col("class").alias("a"), F.col("histogram").alias("of_a")), "a")
    both = both.join(held.select(F.col("class").alias("b"), F.col("histogram").alias("of_b")), "b")
    pairs = checkpointed(both.where(_may_be_similar(p, q)).select("a", "b"))

    # pairs of blocks hold twice a block's sets
    blocks = F.greatest(F.count("*") * 2 / MOST_COMPARED, F.sum("n") * 2 / MOST_SHINGLES)
    sized = hot.groupBy("key").agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = hot.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = ["key", "one", "two"]
    dealt = dealt.select("key", "class", "n", "pos", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    dealt = checkpointed(dealt)

    def proposed(k: int) -> DataFrame:
        salts = [xxhash.xxh64_intdigest(str(i), SEED) for i in range(k * PROPOSED, (k + 1) * PROPOSED)]
        own = dealt.join(held, "class").join(joined.withColumnRenamed("node", "class"), "class", "left")
        own = own.withColumn("component", F.coalesce("component", "class"))
        return checkpointed(own.groupBy(*meet).applyInArrow(_proposals(p, q, salts, k == ROUNDS - 1), PROPOSALS).distinct())

    tried = proposed(0)
    # what later rounds propose are classes of the first one, as components only grow
    first = tried.where("b is not null").select("a", "b").unionByName(tried.where("a is not null and b is null").select("a", F.col("a").alias("b")))
    found = _sets(docs, classes.select("class", "node").join(_ends(pairs.unionByName(first)), "class", "left_semi"))
    links = _confirmed(pairs.unionByName(tried.where("b is not null").select("a", "b")).distinct(), found, p, q)
    for k in range(1, ROUNDS):
        more = tried.where("a is null").select(*meet)
        if more.isEmpty():
            break
        links = checkpointed(links)
        dealt = checkpointed(dealt.join(more, meet, "left_semi"))
        joined = connected_components(known.unionByName(links), "a", "b")
        tried = proposed(k)
        links = links.unionByName(_confirmed(tried.where("b is not null").select("a", "b"), found, p, q))
    whole = tried.where("a is not null and b is null").select(*meet, F.col("a").alias("class"))
    if not whole.isEmpty():
        met_whole = whole.join(found, "class").groupBy(*meet)
        links = links.unionByName(met_whole.applyInArrow(_hot_links(p, q), "a long, b long"))
    return written(links, "links")


def duplicates(docs: DataFrame, near: float = NEAR) -> DataFrame:
    """(doc_id): the documents whose group has a lesser doc_id.

    Groups are components over all pairs of texts whose sets of distinct five-word shingles have a Jaccard similarity of
    ``near`` or more: first those that fingerprints find, then all others. Rows without an id are in no group."""
    docs = docs.where("doc_id is not null")
    rows = signatures(docs, near)
    classes = written(rows.groupBy("class").agg(F.min("row").alias("row"), F.min("doc_id").alias("node")), "classes")
    known = fingerprint_links(docs, rows, classes, near)
    found = connected_components(known.unionByName(near_links(docs, rows, classes, near, known)), "a", "b")
    members = classes.select("class", "node").join(found.withColumnRenamed("node", "member"), F.col("class") == F.col("member"), "left")
    members = members.select("class", "node", F.coalesce("component", "class").alias("component"))
    least = members.groupBy("component").agg(F.min("node").alias("kept"))
    kept = written(members.join(least, "component").select("class", "kept"), "kept")
    return rows.select("doc_id", "class").join(kept, "class").where("doc_id <> kept").select("doc_id").distinct()


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, the one of least id; columns as they were."""
    small_batches(spark)
    short_shuffles(spark)
    gone = written(duplicates(docs).select(F.col("doc_id").alias("gone_id")), "gone")
    if gone.count() <= MOST_BROADCAST:  # else a join that shuffles the texts
        gone = F.broadcast(gone)
    return docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
