"""Operator 12: two tokenizers' tokens of a text, aligned by diagonal run skipping.

Both tokenizers cut the same bytes; a token is known by the byte offset it ends at. While both end together, token for
token, the pair of indices moves along a diagonal: stretches of doubling length are compared at the current index shift and
jumped over whole. Where the ends differ, the tokens up to the next common end are one irregular group, which is resolved by
stepping through it; that changes the shift, and probing begins anew. The tokens that end a group on both sides are linked.

An id pair's count is the number of its links in the whole table. Frequent pairs are broadcast up to a bound, rarer ones
joined; a rare pair has, by the choice of the bound, few links.

A text that is null or empty, or whose bytes one of the vocabularies doesn't give back (a U+2581 in the text, which reads as
a space) has no tokens: zeros and an empty digest. Texts are read whole; rows that repeat count each for itself; an empty table
gives no rows. Only doc_id and text are read, whatever other columns there are. A vocabulary in which a token but the
special ones is empty is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.llm.byteids import MOST_WORDS, ByteIds, vocabulary
from veridelta.llm.common import read, slices, written

#: Id pairs that are broadcast at most (20 bytes each).
MOST_BROADCAST = 1_000_000
#: Words longer than this many letters aren't kept.
LONGEST = 48
ROWS = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " pairs array<long>, times array<int>"
)


class _Words:
    """Ids of texts with a space before them; what is known of words is kept by the worker, up to a bound.

    A word's ids are held against its bytes when it is new, so that a text of known words needs no check."""

    def __init__(self, encode_words, encode_whole, token_bytes: list[bytes]):
        self.encode_words, self.encode_whole, self.token_bytes = encode_words, encode_whole, token_bytes
        self.known: dict[str, bytes] = {}
        self.turned_away = 0

    def _gives(self, ids: bytes, text: str) -> bool:
        return b"".join([self.token_bytes[i] for i in np.frombuffer(ids, "<u4").tolist()]) == (" " + text).encode()

    def encode(self, texts: list[str], regular: list[bool]) -> list[bytes | None]:
        """Ids as bytes; none for a text whose tokens don't give its bytes. ``regular``: words may be encoded alone."""
        known = self.known
        lines = [t.split(" ") if r else None for t, r in zip(texts, regular)]
        new = set().union(*(line for line in lines if line)).difference(known)
        own = self.encode_words(new)
        wrong = set()
        if own and not self._gives(b"".join(own.values()), " ".join(own)):
            wrong = {w for w, ids in own.items() if not self._gives(ids, w)}
        known.update(own)
        rest = iter(self.encode_whole([t for t, r in zip(texts, regular) if not r]))
        out = []
        for text, line in zip(texts, lines):
            if line is None:
                ids = next(rest)
                out.append(ids if self._gives(ids, text) else None)
            else:
                out.append(None if wrong and not wrong.isdisjoint(line) else b"".join(map(known.__getitem__, line)))
        # a full store takes no more words, until it has turned away twice as many as it holds
        full = len(known) > MOST_WORDS
        for w in own:
            if full or len(w) > LONGEST or w in wrong:
                del known[w]
        self.turned_away = self.turned_away + len(own) if full else 0
        if self.turned_away > 2 * MOST_WORDS:
            known.clear()
        return out


class ByteTokens(ByteIds):
    """Ids of a space and a text by a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = []
        names = self.library.get_vocab(with_added_tokens=True)
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printed)]
        letters = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}
        self.token_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            if all(c in letters for c in name):
                self.token_bytes[i] = bytes(letters[c] for c in name)
        self.words = _Words(self._new, lambda whole: self._ids([" " + t for t in whole]), self.token_bytes)

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text with a space before it: its words' ids where words are told by single spaces."""
        return self.words.encode(texts, [bool(t) and self._regular(t) for t in texts])

    def _new(self, words: set[str]) -> dict[str, bytes]:
        found = self._after_space(words)
        self.tails.clear()
        return found


class PieceTokens:
    """Ids of texts by a piece vocabulary, each space-led word encoded once per worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        # no piece reaches from one word into the next, so words are encoded by themselves
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.token_bytes = [
            bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.spaced = np.array([p.startswith("▁") for p in pieces])
        self.words = _Words(self._of_words, self._ids, self.token_bytes)

    def _of_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word with a space before it: all words as one text, cut where a piece begins with a space."""
        if not words:
            return {}
        ids = np.array(self.library.encode(" ".join(words), num_threads=1), "<u4")
        cuts = [*(np.flatnonzero(self.spaced[ids]) * 4).tolist(), 4 * len(ids)]
        flat = ids.tobytes()
        return dict(zip(words, [flat[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.library.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text; the library puts a space before it."""
        return self.words.encode(
            texts,
            [self.by_words and bool(t) and t[0] != " " and t[-1] != " " and "  " not in t and "▁" not in t for t in texts],
        )


def diagonal(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The last token of every group on both sides, for two increasing lists of ends whose last ones are equal."""
    of_a, of_b = [], []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        # an irregular group: the side that is behind goes on until both end together
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        # the longest stretch on this diagonal: doubling probes, then halving ones within the last
        run, step = 1, 1
        while a[i + run : i + run + step] == b[j + run : j + run + step] and i + run + step <= n:
            run += step
            step *= 2
        while step > 1:
            step >>= 1
            if a[i + run : i + run + step] == b[j + run : j + run + step] and i + run + step <= n:
                run += step
        of_a += range(i, i + run)
        of_b += range(j, j + run)
        i, j = i + run, j + run
    return of_a, of_b


class Aligner:
    """Both vocabularies with what is looked up by id."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.lengths, self.names = [], []
        for tokens, signs in ((self.a.token_bytes, (",", "|")), (self.b.token_bytes, (",", ";"))):
            self.lengths.append(np.array([len(t) for t in tokens]))
            # an id's decimal and the sign after it, within a group and at its end
            self.names.append(np.array([[f"{i}{s}" for i in range(len(tokens))] for s in signs], object))

    def align(self, texts: list[str]):
        """(n_a, n_b, groups_sha256, pairs, times) of each text."""
        for text, *both in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            if not text or None in both:
                yield 0, 0, 0, "", [], []
                continue
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in both]
            ends = [np.cumsum(lengths[own]) for lengths, own in zip(self.lengths, ids)]
            if any((np.diff(e, prepend=0) <= 0).any() for e in ends):
                raise ValueError("a token of no bytes")
            last = [np.array(x, np.int64) for x in diagonal(*(e.tolist() for e in ends))]
            pairs, times = np.unique((ids[0][last[0]] << 32) | ids[1][last[1]], return_counts=True)
            yield len(ids[0]), len(ids[1]), len(last[0]), self._digest(ids, last), pairs, times

    def _digest(self, ids: list[np.ndarray], last: list[np.ndarray]) -> str:
        """SHA-256 of the groups: of each, A's ids, a bar, B's ids; the groups parted by semicolons."""
        parts, places = [], []
        for side in (0, 1):
            ends = np.zeros(len(ids[side]), np.int64)
            ends[last[side]] = 1
            parts.append(self.names[side][ends, ids[side]])
            group = np.cumsum(ends) - ends
            # before a token: its own side's earlier ones, and the other side's in earlier groups (A's in this one, too)
            before = np.append(0, last[1 - side] + 1)
            places.append(np.arange(len(ids[side])) + before[group + side])
        line = np.empty(len(ids[0]) + len(ids[1]), object)
        for part, place in zip(parts, places):
            line[place] = part
        return hashlib.sha256("".join(line.tolist())[:-1].encode()).hexdigest()


_HELD: dict[tuple, Aligner] = {}


def _rows(path_a: str, path_b: str):
    def rows(batches):
        if (path_a, path_b) not in _HELD:
            _HELD[path_a, path_b] = Aligner(path_a, path_b)
        aligner, number = _HELD[path_a, path_b], TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                found = list(aligner.align([t or "" for t in texts]))
                columns = list(zip(*found))
                offsets = np.cumsum([0, *(len(p) for p in columns[4])])
                flat = [np.concatenate([np.asarray(x, np.int64) for x in c]) for c in columns[4:6]]
                made = {"row": pa.array(np.arange(number, number + len(texts)))}
                made["doc_id"] = batch.column("doc_id").slice(at, len(texts))
                made |= {n: pa.array(c, pa.int64()) for n, c in zip(("n_a", "n_b", "n_groups"), columns)}
                # tokens have bytes, so each group has one pair of tokens that end together
                made["n_links"] = made["n_groups"]
                made["groups_sha256"] = pa.array(columns[3], pa.string())
                made["pairs"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[0]))
                made["times"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[1], pa.int32()))
                number += len(texts)
                yield pa.RecordBatch.from_pydict(made)

    return rows


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each id pair, and whether none with the same B id has more."""
    links = rows.select(F.arrays_zip("pairs", "times").alias("links")).select(F.inline("links").alias("pair", "times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % (1 << 32))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have as many links."""
    classes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy("level").collect()
    left = sum(r["count"] for r in classes)  # one row a power of two
    for r in classes:
        if left <= most:
            return 1 << r["level"]
        left -= r["count"]
    return 1 << 62


def alignment(docs: DataFrame, path_a: str, path_b: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(texts.mapInArrow(_rows(path_a, path_b), ROWS), "aligned")
    counts = written(pair_counts(rows), "pair-counts")
    least = _frequent_from(counts, most_broadcast)
    links = rows.select("row", F.arrays_zip("pairs", "times").alias("links")).select(
        "row", F.inline("links").alias("pair", "times")
    )
    sums = (
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    # at most ``most_broadcast`` pairs
    frequent = counts.where(F.col("n") >= least)
    found = links.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    if least > 1:
        rare = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
        rare = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
        found = found.unionByName(rare).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    return rows.join(found, "row", "left").select(
        *("doc_id", "n_a", "n_b", "n_groups", "n_links"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")),
        "groups_sha256",
    )


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens by two public vocabularies, aligned, with how usual its links are."""
    return alignment(
        read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    )
