"""Operator 2: byte-pair encoding and decoding with a deterministic automaton.

``compile_merges`` builds an automaton over tokens by one merge gadget after another. It begins with one state, on which
every symbol loops. The gadget of a merge u v -> w makes a copy of the state that u leads to, without its arc for v, lets
u lead to the copy, lets w lead where v led, and gives w's arc to every state that has one for u. Accepted paths are then
exactly the outputs of the merges in their order. A copy is kept as its difference from the state it copies: the arc it
lacks, and since which merge. Whether a state has an arc for a token follows from the token's left parts and the arcs
lacked along the copies; each answer is entered in a table.

The arcs' labels are compiled into a second table, state x symbol -> state, over the tokens' letters: its state is the
longest end of what was read that begins a token, and carries the tokens that end there. Encoding reads a pre-split word
once from left to right, one lookup a symbol; each prefix has one accepted path, of which the last arc is kept. The work
and memory are linear in the word. Decoding emits the labels of the arcs.

A null or empty text has no tokens and decodes to the empty string; texts and words of any length are encoded whole;
repeated rows are encoded alike; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.byteids import vocabulary
from veridelta.llm.common import read

#: Chunks between white space, and words, kept per worker, and the longest kept.
MOST_CHUNKS, LONGEST = 600_000, 48
#: Entries that each of the automaton's two tables is filled with at most while words are read.
MOST_MOVES = 1_000_000
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
WHITE = regex.compile(r"\p{White_Space}+")
#: Separators that str.split() splits at and the vocabulary's pattern doesn't.
ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else one from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Automaton:
    """The compiled merges.

    ``state_of`` is where each token leads; ``copied``, ``lacks`` and ``since`` say what each state copies, the arc it
    lacks and from which merge on; ``left`` and ``made`` are each token's left part and the merge that made it."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.ids = tokens
        self.labels = {i: t for t, i in tokens.items()}
        self.copied, self.lacks, self.since = [-1], [-1], [-1]
        self.state_of = dict.fromkeys(tokens.values(), 0)
        self.left: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.dead: set[int] = set()
        self.moves: dict[int, bool] = {}
        self._lacked: dict[int, dict[int, int]] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, tokens[u], tokens[v], tokens[u + v])
        self._lacked.clear()
        self._read_by(end)

    def _read_by(self, end: str) -> None:
        """Compile the labels: ``steps`` from state and symbol to state, and ``ending``, the tokens that end at a state with
        their lengths, longest first. A symbol that ends a word is its letter with ``end``."""
        self.steps: list[dict[str, int]] = [{}]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        for token, label in self.labels.items():
            body = label.removesuffix(end) if end else label
            if token in self.dead or not body:
                continue
            symbols = [*body[:-1], body[-1] + label[len(body) :]]
            state = 0
            for c in symbols:
                if c not in self.steps[state]:
                    self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    self.ending.append(())
                state = self.steps[state][c]
            self.ending[state] = ((token, len(symbols)),)
        # where a state has no arc, that of the longest shorter end is taken
        self.shorter = [0] * len(self.steps)
        waiting = list(self.steps[0].values())
        for state in waiting:
            for c, to in self.steps[state].items():
                self.shorter[to] = self._step(self.shorter[state], c)
                waiting.append(to)
            self.ending[state] += self.ending[self.shorter[state]]
        self.filled = 0

    def _step(self, state: int, symbol: str) -> int:
        """Where a symbol leads; an entry that has to be found is entered in the table."""
        to = self.steps[state].get(symbol)
        if to is None:
            at = state
            while to is None and at:
                at = self.shorter[at]
                to = self.steps[at].get(symbol)
            to = to or 0
            if getattr(self, "filled", MOST_MOVES) < MOST_MOVES:
                self.filled += 1
                self.steps[state][symbol] = to
        return to

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        state = self.state_of[u]
        self.left[w], self.made[w] = u, rank
        if not self._has(state, v):  # u v never stand side by side: nothing leads to w
            self.dead.add(w)
            return
        self.state_of[w] = self.state_of[v]
        self.copied.append(state)
        self.lacks.append(v)
        self.since.append(rank)
        self.state_of[u] = len(self.copied) - 1

    def _lacked_by(self, state: int) -> dict[int, int]:
        """The arcs that a state lacks, and since which merge."""
        if state not in self._lacked:
            found, at = {}, state
            while at > 0:
                found[self.lacks[at]] = self.since[at]  # the oldest is entered last
                at = self.copied[at]
            if len(self._lacked) > 20_000:
                self._lacked.clear()
            self._lacked[state] = found
        return self._lacked[state]

    def _has(self, state: int, token: int) -> bool:
        if token in self.dead:
            return False
        lacked = self._lacked_by(state)
        if not lacked:
            return True
        until = float("inf")
        while True:
            # the arc for a merged token was given where its left part's was still there
            if token in lacked and lacked[token] <= until:
                return False
            if token not in self.left:
                return True
            until, token = self.made[token], self.left[token]

    def moves_on(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last``: one entry of the transition table."""
        key = last << 32 | token
        found = self.moves.get(key)
        if found is None:
            if len(self.moves) >= MOST_MOVES:
                self.moves.clear()
            found = self.moves[key] = self._has(self.state_of[last], token)
        return found

    def encode(self, symbols: str, end: str = "") -> list[int]:
        """The tokens of a word of symbols, the last of which carries ``end``."""
        steps, ending, moves = self.steps, self.ending, self.moves.get
        state, n, last, sizes = 0, 0, [-1], [0]
        for c in [*symbols[:-1], symbols[-1] + end] if symbols else ():
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            n += 1
            own, size = -1, 1
            for token, length in ending[state]:
                if n == length:
                    own, size = token, length
                    break
                if (before := last[-length]) >= 0:
                    goes = moves(before << 32 | token)
                    if self.moves_on(before, token) if goes is None else goes:
                        own, size = token, length
                        break
            last.append(own)
            sizes.append(size)
        out = []
        while n:
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> list[str]:
        """The labels of the arcs."""
        return [self.labels[i] for i in ids]


class Recent:
    """What was met lately, and what was met before that: what is in use moves on, the rest goes."""

    def __init__(self):
        self.now, self.before = {}, {}

    def get(self, key: str):
        found = self.now.get(key)
        if found is None and (found := self.before.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value):
        if len(key) <= LONGEST:
            if len(self.now) >= MOST_CHUNKS // 2:
                self.before, self.now = dict(self.now), self.now
                self.now.clear()
            self.now[key] = value
        return value


class WordBpe:
    """A vocabulary file with word ends: how texts are split, and the automaton of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = Automaton(dict(model["vocab"]), merges, self.end)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.marks = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True)))
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        self.chunks, self.known = Recent(), Recent()
        # each token's id and label after a space
        self.shown = {i: (f" {i}", f" {t}") for i, t in self.automaton.labels.items()}
        # whether a run of ASCII letters is one word, and a sign after it another, so that no pattern is asked
        letters = "abcdefghijklmnopqrstuvwxyz"
        self.ends = {c for c in ".,;:!?)(*-" if self.words.findall(f"{letters}{c}") == [letters, c]}

    def word(self, word: str) -> tuple[str, str]:
        """The ids and the labels of one pre-split word, each after a space."""
        found = self.known.now.get(word) or self.known.get(word)
        if found is None:
            plain = word.isascii() and word.isprintable()  # its bytes' letters are the letters themselves
            symbols = word if plain else "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))
            shown = [self.shown[i] for i in self.automaton.encode(symbols, self.end)]
            found = self.known.keep(word, ("".join([i for i, _ in shown]), "".join([t for _, t in shown])))
        return found

    def _both(self, chunk: str) -> tuple[str, str]:
        """The ids and the labels of a stretch without white space, each after a space."""
        found = self.chunks.get(chunk)
        if found is None:
            low = chunk
            if not low.isascii():
                low = unicodedata.normalize("NFC", low)
            # letter by letter: a word's last sigma is no exception
            low = "".join(c.lower() for c in low) if "Σ" in low else low.lower()
            if low.isascii() and self.ends and low.isalpha():
                found = self.word(low)
            elif low.isascii() and low[-1:] in self.ends and low[:-1].isalpha():
                (ids, labels), (more, other) = self.word(low[:-1]), self.word(low[-1])
                found = ids + more, labels + other
            else:
                words = [self.word(m.group()) for m in self.words.finditer(low)]
                found = "".join([i for i, _ in words]), "".join([t for _, t in words])
            self.chunks.keep(chunk, found)
        return found

    def text(self, text: str) -> tuple[str, str]:
        """A whole text's ids and decoded text, each with a space before every token."""
        if any(s in text for s in self.special):
            parts = []
            for part in filter(None, self.marks.split(text)):
                parts.append((f" {self.special[part]}", f" {part}") if part in self.special else self.text(part))
        else:
            chunks = [c for c in WHITE.split(text) if c] if ODD.search(text) else text.split()
            get, both = self.chunks.now.get, self._both
            parts = [get(c) or both(c) for c in chunks]
        return "".join([i for i, _ in parts]), "".join([t for _, t in parts])


_HELD: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """This worker's compiled vocabulary."""
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
    return _HELD[path]


def encode_ids(path: str, column: str | Column) -> Column:
    """The ids of each whole text."""

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        bpe = word_bpe(path)
        return pd.Series([[int(i) for i in bpe.text(t or "")[0].split()] for t in texts], index=texts.index)

    return ids_of(column)


def decode_ids(path: str, column: str | Column) -> Column:
    """The text of each array of ids: the labels of its arcs, joined by spaces; null stays null."""

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        bpe = word_bpe(path)
        labels = bpe.automaton.labels | {i: s for s, i in bpe.special.items()}
        return pd.Series([None if r is None else " ".join(labels[int(i)] for i in r) for r in rows], index=rows.index)

    return text_of(column)


def digest(path: str, column: str | Column) -> Column:
    """The number of tokens and the checksums of ids and decoded text of each whole text."""

    @F.pandas_udf(SCHEMA)
    def digests(texts: pd.Series) -> pd.DataFrame:
        bpe, out = word_bpe(path), []
        for text in texts:
            ids, decoded = bpe.text(text or "")
            sums = (hashlib.sha256(x[1:].encode("utf-8")).hexdigest() for x in (ids, decoded))
            out.append((ids.count(" "), *sums))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(column)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", digest(vocabulary("word_bpe_49k.json"), "text").alias("d")).select("doc_id", "d.*")
