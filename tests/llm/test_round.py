"""Exact duplicates, alignment of two tokenizers, phrase collocations."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from veridelta.llm import align, collocations, exact
from veridelta.llm.byteids import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
@pytest.mark.parametrize("bits", [1, 20, 50])
def test_golomb_codes_are_read_back(n, bits):
    draw = random.Random(n)
    values = np.array(sorted(draw.randrange(1 << bits) for _ in range(n)), np.int64)
    gaps = np.diff(values, prepend=0)
    assert (exact.ungolomb(exact.golomb(gaps, 1 << bits)).astype(np.int64) == gaps).all()


def test_golomb_codes_are_short():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 10_000))
    assert 8 * len(exact.golomb(np.diff(values, prepend=0), 1 << 40)) < 10_000 * (40 - np.log2(10_000) + 2)


def plain_duplicates(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(map(repr, out))


@pytest.mark.parametrize("most_broadcast", [exact.MOST_BROADCAST, 0])
@pytest.mark.parametrize("block", [exact.LIST, 4])
def test_exact_duplicates_are_the_plain_ones(spark, monkeypatch, most_broadcast, block):
    monkeypatch.setattr(exact, "LIST", block)
    copies = [(100 + k, "the  same\ttext") for k in range(300)] + [(k, "the same text") for k in (99, 900)]
    alone = [(1000 + k, f"text {k}") for k in range(200)] + [(None, "nobody's"), (None, "nobody's"), (7, None)]
    ids = spark.createDataFrame(copies + alone + ROWS, "doc_id long, text string").repartition(5)
    ids = ids.withColumns({n: F.lit("clash") for n in ("fp", "norm", "sha", "keep_id", "owner", "dealt", "kept")})
    found = exact.duplicates(ids, most_broadcast).collect()
    assert sorted(repr(tuple(r)) for r in found) == plain_duplicates(copies + alone + ROWS)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    # a hash of few values: nearly every row is a suspect
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(c[0]) % 3)
    rows = [(k, "x" * (k % 40)) for k in range(400)]
    found = exact.duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0)
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_duplicates(rows)


def test_exact_duplicates_of_nothing(no_docs):
    assert exact.duplicates(no_docs).collect() == []


def test_diagonal_finds_every_common_end():
    draw = random.Random(3)
    for _ in range(5000):
        n, p = draw.randint(1, 60), draw.choice([0.1, 0.5, 0.9, 1.0])
        a, b = (sorted({x for x in range(1, n) if draw.random() < p} | {n}) for _ in "ab")
        of_a, of_b = align.diagonal(a, b)
        assert [a[i] for i in of_a] == [b[j] for j in of_b] == sorted(set(a) & set(b))


ODD = ["  x", "a  b ", "<|endoftext|> hi<|endoftext|>", "a▁b", "\nq\t w", "é 中文 😀", "foo ▁bar", " ", "　x y z", "<s> <0x41>", "a\0b"]


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B)


def plain_alignment(rows, aligner):
    """By the libraries themselves and sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    links, docs = [], []
    for doc_id, text in rows:
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        bytes_a, bytes_b = ([side.token_bytes[i] for i in x] for side, x in ((aligner.a, a), (aligner.b, b)))
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append((doc_id, [], [], []))
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            total, at = 0, {}
            for k, part in enumerate(parts):
                total += len(part)
                at[total] = k
            ends.append(at)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in common:
            i2, j2 = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        pairs = [(a[ends[0][e]], b[ends[1][e]]) for e in common]
        links += pairs
        docs.append((doc_id, a, b, groups, pairs))
    counts, best = Counter(links), Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, a, b, groups, *pairs in docs:
        pairs = pairs[0] if pairs else []
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        good = sum(counts[p] == best[p[1]] for p in pairs)
        out.append((doc_id, len(a), len(b), len(groups), len(pairs), good, sum(counts[p] for p in pairs), digest))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most_broadcast", [align.MOST_BROADCAST, 5, 0])
def test_alignment_is_the_plain_one(spark, aligner, most_broadcast):
    rows = ROWS + [(100 + k, t) for k, t in enumerate(ODD)] + [(200 + k, "an apple and the café near " + "x" * k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({n: F.lit("clash") for n in ("row", "pairs", "times", "n", "best", "n_a")})
    found = align.alignment(docs, A, B, most_broadcast)
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain_alignment(rows, aligner)


def test_alignment_forgets_and_learns_words_again(monkeypatch, aligner):
    texts = ["some words of a text", "other words and some more", "some words", "a text"] * 3
    whole = [list(map(repr, x)) for x in aligner.align(texts)]
    monkeypatch.setattr(align, "MOST_WORDS", 3)
    small = align.Aligner(A, B)
    assert [list(map(repr, x)) for t in texts for x in small.align([t])] == whole


def test_alignment_of_nothing(no_docs):
    assert align.alignment(no_docs, A, B).collect() == []


def plain_collocations(rows, least, covered, best):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if a >= least and " " in p}
        cover, rows_ = Counter(), []
        for p, a in candidates.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    q = " ".join(w[i : i + size])
                    cover[q] = max(cover[q], a)
        for p, a in candidates.items():
            w = p.split(" ")
            ends = [(count[" ".join(w[:k])], count[" ".join(w[k:])], k) for k in range(1, len(w))]
            score, _, left, right = min((2000000 * a // (x + y), k, x, y) for x, y, k in ends)
            if not cover[p] or 100 * cover[p] < covered * a:
                rows_.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    draw = random.Random(11)
    words = ["The", "of", "é中", "rain", "in", "Spain", "falls", "x\x85y", ".", "a\x1cb", "!", "\n", "stays", "mainly"]
    rows = [(draw.choice(["en", "de", None]), " ".join(draw.choices(words, k=draw.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "the quick brown fox jumps over the lazy dog, again")] * 70
    rows += [("fr", None), ("fr", ""), (None, " . "), ("de", "one  two\tthree;four " * 2000), ("es", "no " * 3000)]
    return rows


@pytest.mark.parametrize("apart", [collocations.APART, 2, 1])
def test_collocations_are_the_plain_ones(spark, monkeypatch, spoken, apart):
    monkeypatch.setattr(collocations, "APART", apart)
    rows = [(k, *r) for k, r in enumerate(spoken)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    docs = docs.withColumns({n: F.lit("clash") for n in ("phrase", "n", "f", "words", "rank", "k", "last", "chunk")})
    found = collocations.collocations(docs, least=20, best=50).collect()
    assert sorted(map(tuple, found)) == plain_collocations(spoken, 20, 80, 50)


def test_chunks_overlap_and_assign_every_word_once(monkeypatch):
    monkeypatch.setattr(collocations, "APART", 3)
    draw = random.Random(5)
    for size in (1, 3, 4, 5, 200):
        tokens = [str(draw.randrange(30)) for _ in range(size)]
        found = collocations.chunks_of(pa.array(["", " ".join(tokens), " \t", "other , words"]))
        rows = list(zip(found["text"].tolist(), found["last"].tolist(), found["begins"].tolist(), found["chunk"].to_pylist()))
        assert rows[-1] == (3, True, 2, "other . words")
        chunks = [c.split() for text, *_, c in rows if text == 1]
        assert [last for text, last, *_ in rows if text == 1] == [False] * (len(chunks) - 1) + [True]
        assert [w for c in chunks[:-1] for w in c[: -collocations.WINDOW]] + chunks[-1] == tokens
        assert sum(begins for text, _, begins, _ in rows if text == 1) == size


def test_copies_share_their_chunks(spark, monkeypatch):
    draw = random.Random(6)
    passage = " ".join(str(draw.randrange(500)) for _ in range(2000))
    rows = [("en", f"own words {k} " + passage) for k in range(40)]
    chunks = collocations.dictionary(spark.createDataFrame(rows, "lang string, text string")).collect()
    tokens = sum(len(r.chunk.split()) for r in chunks)
    assert tokens < 3 * 2000 + 40 * 300


def test_scores_past_64_bits(spark):
    # 2,000,000 * a doesn't fit 64 bits
    a = 9 * 10**15
    assert spark.sql(f"select (cast({a} as decimal(20,0)) * 2000000) div (cast({a} as decimal(20,0)) + {a + 1})").first()[0] == 999999


def test_collocations_of_nothing(no_docs):
    assert collocations.collocations(no_docs).collect() == []
