"""Tokens, files and packing against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ROWS
from veridelta.llm import bpe, byteids, dac, packing

ALPHABET = ["a", "B", " ", "  ", "\n", "'s", "'LL", " 1", "é", "é", "\x1c", "　", "<|endoftext|>", "!", "\t", "Σ"]
ALPHABET += ["İ", "ß", "'", "🙂", "中", "the", "ing", "aaaa", " \n", "\x85", "½", "\x00", "the,", "ing!!", "."]


def fuzz(n):
    draw = random.Random(5)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def library(name):
    found = Tokenizer.from_file(byteids.vocabulary(name))
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def byte_library():
    return library("byte_bpe_50k.json")


def test_word_bpe_is_the_library(docs):
    ours, theirs = bpe.word_bpe(byteids.vocabulary("word_bpe_49k.json")), library("word_bpe_49k.json")
    for text in fuzz(1500):
        ids, decoded = ours.text(text)
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids[1:] == " ".join(map(str, want))
        assert decoded[1:] == theirs.decode(want, skip_special_tokens=False)


def test_long_words_are_the_library():
    ours, theirs = bpe.word_bpe(byteids.vocabulary("word_bpe_49k.json")), library("word_bpe_49k.json")
    draw = random.Random(2)
    for n in (31, 32, 33, 200, 5000):
        for letters in ("a", "ab", "etaoins", "éß中a"):
            word = "".join(draw.choice(letters) for _ in range(n))
            assert ours.text(word)[0][1:] == " ".join(map(str, theirs.encode(word, add_special_tokens=False).ids))


def test_a_word_of_a_million_letters():
    ours, draw = bpe.word_bpe(byteids.vocabulary("word_bpe_49k.json")), random.Random(9)
    word = "".join(draw.choice("thequickbrown") for _ in range(1_000_000))
    began = time.process_time()
    ids, decoded = ours.text(word)
    assert time.process_time() - began < 60
    assert decoded.replace(" ", "") == word + "</w>" and ids.count(" ") == decoded.count(" ")


def test_bpe_table_is_deterministic_and_reads_one_symbol_at_a_time():
    tokens = {t: i for i, t in enumerate(["a", "b", "a.", "b.", "ab", "ab."])}
    found = bpe.Automaton(tokens, [("a", "b"), ("a", "b.")], end=".")
    assert found.decode(found.encode("ab", ".")) == ["ab."]
    assert found.decode(found.encode("aba", ".")) == ["ab", "a."]
    assert all(isinstance(to, int) for row in found.steps for to in row.values())


def test_bpe_of_nothing(no_docs):
    path = byteids.vocabulary("word_bpe_49k.json")
    out = no_docs.withColumn("d", bpe.digest(path, "text"))
    assert out.count() == 0 and out.columns == [*no_docs.columns, "d"]


def test_automaton_follows_merge_order():
    tokens = {t: i for i, t in enumerate(["a", "b", "aa", "ab", "aab"])}
    found = bpe.Automaton(tokens, [("a", "a"), ("a", "b"), ("aa", "b")])
    text = lambda s: found.decode(found.encode(s))
    assert text("aaa") == ["aa", "a"]
    assert text("aaaa") == ["aa", "aa"]
    assert text("aab") == ["aab"]
    assert text("aaab") == ["aa", "ab"]


def test_bpe_query_digests(docs):
    got = docs.select("doc_id", bpe.digest(byteids.vocabulary("word_bpe_49k.json"), "text").alias("d")).select("doc_id", "d.*")
    theirs = library("word_bpe_49k.json")
    want = []
    for doc_id, text in ROWS:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), theirs.decode(ids, skip_special_tokens=False))]
        want.append((doc_id, len(ids), *sums))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_bpe_round_trip(docs):
    path = byteids.vocabulary("word_bpe_49k.json")
    got = docs.select("text", bpe.encode_ids(path, "text").alias("ids")).select("text", "ids", bpe.decode_ids(path, "ids").alias("back"))
    theirs = library("word_bpe_49k.json")
    for r in got.collect():
        assert r.ids == theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.back == theirs.decode(r.ids, skip_special_tokens=False)


def test_byte_ids_are_the_library(byte_library, monkeypatch):
    monkeypatch.setattr(byteids, "MOST_WORDS", 50)
    ours = byteids.ByteIds(byteids.vocabulary("byte_bpe_50k.json"))
    texts = fuzz(3000) + [t for _, t in ROWS]
    want = [np.array(byte_library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    got = [x for at in range(0, len(texts), 64) for x in ours.encode(texts[at : at + 64])]
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [2, 256, 257, 50257, 2**32])
def test_codes_round_trip_and_random_access(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    codes = dac.Codes(dac.encode(ids))
    assert len(codes) == n and (codes.all() == ids).all()
    some = np.random.default_rng(1).permutation(n)
    assert (codes.at(some) == ids[some]).all()


def test_token_files(spark, docs, byte_library, tmp_path, monkeypatch):
    monkeypatch.setattr(dac, "BLOCK", 500)
    folder = f"file://{tmp_path}/tokens"
    dac.write(docs, folder, byteids.vocabulary("byte_bpe_50k.json"))
    rows = dac.blocks(spark, folder).select("doc_ids", "doc_starts", "start", "shard_start", "payload")
    got = rows.mapInArrow(dac._digests, "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()
    at, flat = 0, []
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, text) in zip(got, order):
        ids = np.array([*byte_library.encode(text or "", add_special_tokens=False).ids, dac.END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        flat += ids.tolist()
    some = [0, 17, at - 1, at // 2]
    found = {r.position: r.token for r in dac.tokens_at(spark, folder, some).collect()}
    assert found == {p: flat[p] for p in some}
    assert dac.tokens_at(spark, folder, [at, at + 5, -1]).count() == 0 and dac.tokens_at(spark, folder, []).count() == 0


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    folder = f"file://{tmp_path}/none"
    dac.write(no_docs, folder, byteids.vocabulary("byte_bpe_50k.json"))
    assert dac.blocks(spark, folder).count() == 0 and dac.tokens_at(spark, folder, [0]).count() == 0


def packed_right(rows, ids_of, limits=packing.Limits()):
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        used, n = at.get(r.sequence_id, (0, 0))
        assert r.offset == used
        at[r.sequence_id] = used + r.length, n + 1
    assert all(used <= limits.tokens and n <= limits.segments for used, n in at.values())


def test_packing_documents(docs, byte_library):
    got = packing.pack_documents(docs, byteids.vocabulary("byte_bpe_50k.json")).collect()
    packed_right(got, None)
    want = []
    for doc_id, text in ROWS:
        ids = np.array([*byte_library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(want, key=str)


def test_packing_nothing(no_docs):
    assert packing.pack_documents(no_docs, byteids.vocabulary("byte_bpe_50k.json")).count() == 0


def test_all_limits_hold_and_little_is_lost():
    draw = np.random.default_rng(2)
    tokens = draw.integers(1, 2049, 5000)
    loss = (tokens * draw.random(5000)).astype(int)
    limits = np.array([2048, 16, 1200])
    sizes = np.column_stack([tokens, np.ones_like(tokens), np.minimum(loss, 1200)])
    bins, offsets = packing.dot_product_bins(sizes, limits)
    for b in range(bins.max() + 1):
        own = bins == b
        assert (sizes[own].sum(0) <= limits).all()
        assert sorted(zip(offsets[own], sizes[own, 0]))[0][0] == 0
    least = (sizes.sum(0) / limits).max()
    assert bins.max() + 1 <= 1.1 * least + 1


def test_too_large_an_example_is_an_error():
    with pytest.raises(ValueError):
        packing.dot_product_bins(np.array([[3000, 1, 1]]), np.array([2048, 16, 2048]))
