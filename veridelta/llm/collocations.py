"""Operator 13: phrase collocations over a prefix-free parse.

A text is words and the breaks between its pieces. It is cut into chunks where a window of three tokens has a hash that is
a trigger; a chunk begins with the window that the one before it ended with. The distinct chunks of a language, with how often
each occurs, are the dictionary: what repeats is cut alike wherever it stands, and is counted once. N-grams are counted inside
distinct chunks, weighted. Each belongs to the chunk that holds its first word before the closing window (a text's last chunk
has none), so that overlaps are assigned once, and up to four words always lie in one chunk.

Phrases that are too rare to be candidates are sieved level by level: hashes of n-grams are counted only where the
shorter ones inside them passed, and those with counts of ``least`` or more are set in a bitmap of fixed size, which is broadcast. A hash
that others share only lets more pass. Last, the phrases that pass are counted by their own words, so counts are exact.

A null lang is ``und``; null and empty texts have no words. Rows that repeat count each for itself, rows without a doc_id too.
A text without a trigger is one chunk, however long. An empty table gives no rows. Only lang and text are read, whatever
other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.llm.common import read, whole_text, written

#: Words of a phrase at most; windows are one shorter, so that a phrase never outgrows an overlap.
LONGEST = 4
WINDOW = LONGEST - 1
#: One window in so many is a trigger.
APART = 48
#: Occurrences of a candidate; a longer one with this many per cent of its occurrences replaces a phrase; rows of a language.
LEAST, COVERED, BEST = 30, 80, 2000
#: Bits of a bitmap (16 MB), in pages of 8 KB.
SIEVE_BITS, PAGE_BITS = 27, 16
#: Texts and chunks that are cut and counted at a time.
TEXTS, CHUNKS = 512, 8192
#: Stands for the break between two pieces; no word holds it.
BREAK = "."
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(strings: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)


class _Tokens:
    """The tokens of a column of lists: their strings, numbers, hashes, and the list that each is in."""

    def __init__(self, lists: pa.ListArray):
        self.flat = lists.flatten()
        coded = self.flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary.to_pylist()
        hashes = _hashes(self.words)
        self.hashes = hashes[self.codes]
        self.real = self.hashes != _hashes([BREAK])[0]
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.of = np.repeat(np.arange(len(lengths)), lengths)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hashes of n-grams from those of their first words and of their last one."""
    mixed = (left * np.uint64(0xFF51AFD7ED558CCD)) + right
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    return mixed ^ (mixed >> np.uint64(29))


def tokens_of(texts: pa.Array) -> pa.Array:
    """The words of each text, A-Z in lower case, and a break between its pieces."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), r"[.,;:!?\x0A-\x0D]+", f" {BREAK} ")
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))


def chunks_of(texts: pa.Array) -> dict[str, pa.Array | np.ndarray]:
    """The chunks of some texts: of which text, whether its last, how many words begin in it, and the chunk."""
    lists = tokens_of(texts)
    lists = lists.filter(kept := pc.not_equal(pc.ascii_trim_whitespace(texts), ""))
    numbers = np.flatnonzero(kept.to_numpy(zero_copy_only=False))
    t = _Tokens(lists)
    h, place = t.hashes, np.arange(len(t.codes))
    # a window that is a trigger begins a chunk, unless a text begins or ends with it
    windows = np.ones(len(h), np.uint64)
    windows[:-2] = _joined(_joined(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else windows[:-2]
    cut = (windows % np.uint64(APART) == 0) & (place > t.starts[t.of]) & (place + WINDOW < t.ends[t.of])
    cut[t.starts] = True
    starts = np.flatnonzero(cut)
    of = t.of[starts]
    last = np.append(of[1:] != of[:-1], np.ones(min(len(of), 1), bool))
    ends = np.where(last, t.ends[of], np.append(starts[1:], 0) + WINDOW) if len(of) else starts
    before = np.append(0, np.cumsum(t.real))
    begins = before[np.where(last, ends, ends - WINDOW)] - before[starts]
    lengths = ends - starts
    offsets = np.append(0, np.cumsum(lengths))
    tokens = t.flat.take(pa.array(np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])))
    chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")
    return {"text": numbers[of], "last": last, "begins": begins, "chunk": chunks}


def _parse(batches):
    """(lang, text) to chunks."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            found = chunks_of(part.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": part.column("lang").take(pa.array(found["text"])),
                    "last": pa.array(found["last"]),
                    "begins": pa.array(found["begins"], pa.int64()),
                    "chunk": found["chunk"],
                }
            )


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, last, begins, chunk, n): the distinct chunks of each language, how many words begin in them, how often they
    occur."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    parsed = texts.mapInArrow(_parse, "lang string, last boolean, begins long, chunk string")
    return parsed.groupBy("lang", "last", "begins", "chunk").agg(F.count("*").alias("n"))


class _Grams:
    """The n-grams up to ``longest`` words that a batch of chunks counts, as arrays over its tokens.

    ``levels``: their hashes by the place of their first word; ``passed``: whether they pass the sieves that there are."""

    def __init__(self, batch: pa.RecordBatch, sieves: list[np.ndarray], longest: int):
        self.tokens = t = _Tokens(pc.split_pattern(batch.column("chunk"), " "))
        place, end = np.arange(len(t.codes)), t.ends[t.of]
        last = batch.column("last").to_numpy(zero_copy_only=False)[t.of]
        self.weights = batch.column("n").to_numpy()[t.of]
        langs = batch.column("lang").dictionary_encode()
        begins = t.real & ((place < end - WINDOW) | last)
        seeds = _hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy()]
        self.levels, self.passed = [_joined(seeds[t.of], t.hashes)], []
        through = t.real
        for n in range(1, longest + 1):
            if n > 1:
                # the words after the first, too, must pass; they lie in the same chunk
                both = np.zeros(len(place), bool)
                both[:-1] = through[:-1] & through[1:] & (t.of[:-1] == t.of[1:])
                through = both
                level = np.zeros(len(place), np.uint64)
                level[: 1 - n] = _joined(self.levels[-1][: 1 - n], t.hashes[n - 1 :])
                self.levels.append(level)
            if n <= len(sieves):
                through = through & _in(sieves[n - 1], self.levels[-1], through)
            self.passed.append(begins & through)


def _in(sieve: np.ndarray, hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether the hashes are set in a bitmap; only those asked for are looked up."""
    out = np.zeros(len(hashes), bool)
    places = hashes[asked] >> np.uint64(64 - SIEVE_BITS)
    out[asked] = sieve[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8) & 1
    return out


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each distinct key's first copy in sorting order, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def _hash_counts(sieves, sizes: tuple[int, ...]):
    """Chunks to (hash, n) of the n-grams of some sizes that pass the sieves; words are summed here, as they repeat most."""

    def counts(batches):
        known = [s.value for s in sieves]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS):
                grams = _Grams(batch.slice(at, CHUNKS), known, max(sizes))
                for n in sizes:
                    hashes, weights = (x[grams.passed[n - 1]] for x in (grams.levels[n - 1], grams.weights))
                    if n == 1:
                        first, weights = _summed(hashes, weights)
                        hashes = hashes[first]
                    yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64)), "n": pa.array(weights)})

    return counts


def _pages(batches):
    """(page, hash) rows to pages of the bitmap, one for each that a task has bits for."""
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        places = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
        for page in np.unique(places >> np.uint64(PAGE_BITS)).tolist():
            inside = places[places >> np.uint64(PAGE_BITS) == page] & np.uint64((1 << PAGE_BITS) - 1)
            bits = pages.setdefault(page, np.zeros(1 << PAGE_BITS, bool))
            bits[inside.astype(np.int64)] = True
    yield pa.RecordBatch.from_pydict(
        {
            "page": pa.array(list(pages), pa.int64()),
            "bits": pa.array([np.packbits(b, bitorder="little").tobytes() for b in pages.values()], pa.binary()),
        }
    )


def _sieve(counts: DataFrame, least: int) -> np.ndarray:
    """The bitmap of the hashes with ``least`` or more occurrences: 16 MB, whatever their number."""
    hashes = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")
    page = F.shiftrightunsigned("hash", 64 - SIEVE_BITS + PAGE_BITS)
    pages = hashes.repartition(page).mapInArrow(_pages, "page long, bits binary")
    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    size = 1 << (PAGE_BITS - 3)
    for row in pages.toArrow().to_pylist():  # at most 2048 pages
        out[row["page"] * size : (row["page"] + 1) * size] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _phrases(sieves):
    """Chunks to (lang, words, phrase, n) of all n-grams that pass the sieves, told apart by their own words."""

    def phrases(batches):
        known = [s.value for s in sieves]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS):
                part = batch.slice(at, CHUNKS)
                grams = _Grams(part, known, LONGEST)
                t, langs = grams.tokens, part.column("lang").dictionary_encode()
                # an n-gram's number: that of its first words, the language included, and its last word's
                size = len(t.words)
                numbers = langs.indices.to_numpy().astype(np.int64)[t.of] * size + t.codes
                for n, here in enumerate(grams.passed, 1):
                    if n > 1:
                        places = np.flatnonzero(grams.passed[n - 2])
                        ranks = np.zeros(len(numbers), np.int64)
                        ranks[places] = np.unique(numbers[places], return_inverse=True)[1]
                        numbers = ranks * size
                        numbers[: 1 - n] += t.codes[n - 1 :]
                    places = np.flatnonzero(here)
                    first, weights = _summed(numbers[places], grams.weights[places])
                    places = places[first]
                    words = [list(map(t.words.__getitem__, t.codes[places + k].tolist())) for k in range(n)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": part.column("lang").take(pa.array(t.of[places])),
                            "words": pa.array(np.full(len(places), n, np.int32)),
                            "phrase": pa.array(map(" ".join, zip(*words)), pa.string()),
                            "n": pa.array(weights),
                        }
                    )

    return phrases


def frequent_phrases(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): all phrases of up to four words with ``least`` or more occurrences."""
    context, sieves = chunks.sparkSession.sparkContext, []
    # few n-grams of three words or more are left by then: they are sieved together
    for sizes in ((1,), (2,), tuple(range(3, LONGEST + 1))):
        counts = chunks.mapInArrow(_hash_counts(sieves, sizes), "hash long, n long")
        sieve = context.broadcast(_sieve(counts, least))
        sieves = [*sieves, *(sieve for _ in sizes)]
    found = chunks.mapInArrow(_phrases(sieves), "lang string, words int, phrase string, n long")
    sums = found.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    return sums.where(F.col("f") >= least)


def _with_counts(cuts: DataFrame, phrases: DataFrame, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of a part. A part that very many candidates share is one key: both sides are dealt out for
    the join alone (the last key says nothing new), so that adaptive execution may split it."""
    counts = phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    dealt = [df.withColumn("dealt", F.xxhash64("lang", part)) for df in (cuts, counts)]
    return dealt[0].join(dealt[1], ["lang", part, "dealt"]).drop("dealt")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``best`` phrases of two to four words."""
    chunks = written(dictionary(docs), "chunks")
    phrases = written(frequent_phrases(chunks, least), "phrases")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("begins") * F.col("n")).alias("n"))
    candidates = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    k = F.col("k")
    cuts = candidates.select("lang", "words", "phrase", "w", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", part(F.lit(1), k).alias("head"), part(k + 1, F.col("words") - k).alias("tail"))
    cuts = _with_counts(_with_counts(cuts, phrases, "head", "l"), phrases, "tail", "r")
    score = F.expr("(cast(f as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    lowest = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", F.col("f").alias("a"), "l", "r")).alias("cut"))
        .select("lang", "phrase", "cut.*")
    )
    # every phrase of two words or more that a longer candidate holds, with the most frequent of these
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("words") - size + 1),
                lambda start: F.array_join(F.slice("w", start, size), " "),
            ),
        )
    )
    longer = candidates.where("words > 2").select("lang", "f", F.explode(inside).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    dropped = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {covered}")
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~dropped)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    # one row a language
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases."""
    return collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
counts AS (
    SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM words, (VALUES (1), (2), (3), (4)) AS sizes(k))
    GROUP BY lang, k, phrase HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
    SELECT lang, phrase, f, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail
    FROM candidates, (VALUES (1), (2), (3)) AS places(c) WHERE c < k),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.f AS a, c, h.f AS l, t.f AS r, (2000000::HUGEINT * cuts.f) // (h.f + t.f) AS score
    FROM cuts JOIN counts h ON h.lang = cuts.lang AND h.phrase = head JOIN counts t ON t.lang = cuts.lang AND t.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, f, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
        FROM candidates, (VALUES (2), (3)) AS sizes(s) WHERE s < k)
    GROUP BY lang, phrase)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT lowest.lang, phrase, a, l, r, score::BIGINT AS score,
        row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest LEFT JOIN longer USING (lang, phrase)
    WHERE longer.f IS NULL OR 100 * longer.f < 80 * a)
JOIN (SELECT lang, n::BIGINT AS n FROM totals) USING (lang)
WHERE rank <= 2000
"""
