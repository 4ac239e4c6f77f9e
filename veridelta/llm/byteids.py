"""Byte-level BPE ids of whole texts by the tokenizers library, each word encoded once per worker.

The library's pattern never lets a token cross from one space-led word to the next, so a text's ids are its words' ids in
order. A worker keeps the ids of the words it has met, up to a bound, and asks the library for new ones in batches. Texts
that hold a special token's string are given to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from veridelta.llm.common import kept

#: White space as the library's pattern knows it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: A space and more white space: words can't then be told by single spaces.
UNEVEN = [" " + c for c in " \n\t\r\x0b\x0c"]
UNEVEN_WIDE = re.compile(rf" [{SPACE}]")
#: Signs that may end a word; not the quote, which contractions begin with.
SIGNS = ".,;:!?*$&%#|)"
#: Words kept per worker, and the longest kept.
MOST_WORDS, LONGEST = 500_000, 48


class _Known:
    """Words and their ids, up to a bound. A full one takes no more, until it has turned away twice as many as it holds."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.turned_away = 0

    def add(self, found: dict[str, bytes]) -> None:
        if len(self.now) < MOST_WORDS:
            self.now.update((w, ids) for w, ids in found.items() if len(w) <= LONGEST)
            return
        self.turned_away += len(found)
        if self.turned_away > 2 * MOST_WORDS:
            self.now.clear()
            self.turned_away = 0


class ByteIds:
    """Texts to their ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        letters = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(letters.values()) + 1, bool)
        self.spaced[[i for t, i in letters.items() if t.startswith("\u0120")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # what begins a text or has its white space with it, and what follows a space
        self.whole, self.after = _Known(), _Known()
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _after_space(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word with a space before it.

        Letters and signs after them are tokens apart, so a word that ends in signs is put together from both."""
        known, tails = self.after.now, self.tails
        bare, signed, new_tails = set(), [], set()
        for word in words:
            core = word.rstrip(SIGNS)
            if len(core) < len(word) and core.isalpha():
                tail = word[len(core) :]
                signed.append((word, core, tail))
                if core not in known:
                    bare.add(core)
                if tail not in tails:
                    new_tails.add(tail)
            else:
                bare.add(word)
        bare, new_tails = list(bare), list(new_tails)
        own = dict(zip(bare, self._ids_after_space(bare)))
        tails.update(zip(new_tails, self._ids(new_tails)))
        for word, core, tail in signed:
            own[word] = (own.get(core) or known[core]) + tails[tail]
        if len(tails) > 10_000:
            tails.clear()
        return own

    def _ids_after_space(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it: all words as one text, cut where a token begins with a space."""
        if not words:
            return []
        (found,) = self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = [*(np.nonzero(self.spaced[ids])[0] * 4).tolist(), 4 * len(ids)]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def _regular(self, text: str) -> bool:
        """Whether the text is words with single spaces between them, other white space only within what it splits to."""
        if text[0] == " " or text[-1] == " " or any(pair in text for pair in UNEVEN):
            return False
        return text.isascii() or not UNEVEN_WIDE.search(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        plans, new_whole, new_after = [], set(), set()
        for text in texts:
            whole, after = [], []
            if not text:
                pass
            elif any(s in text for s in self.special):
                whole = [text]
            elif self._regular(text):
                after = text.split(" ")
                whole = [after.pop(0)]
            else:
                whole = UNIT.findall(text)
            got_whole, got_after = list(map(self.whole.now.get, whole)), list(map(self.after.now.get, after))
            gaps_whole = [k for k, ids in enumerate(got_whole) if ids is None]
            gaps_after = [k for k, ids in enumerate(got_after) if ids is None]
            new_whole.update(map(whole.__getitem__, gaps_whole))
            new_after.update(map(after.__getitem__, gaps_after))
            plans.append((got_whole, [(k, whole[k]) for k in gaps_whole], got_after, [(k, after[k]) for k in gaps_after]))
        own_whole = dict(zip(new_whole, self._ids(list(new_whole))))
        own_after = self._after_space(new_after)
        out = []
        for got_whole, gaps_whole, got_after, gaps_after in plans:
            for k, w in gaps_whole:
                got_whole[k] = own_whole[w]
            for k, w in gaps_after:
                got_after[k] = own_after[w]
            out.append(b"".join(got_whole) + b"".join(got_after))
        self.whole.add(own_whole)
        self.after.add(own_after)
        return out


def byte_ids(path: str) -> ByteIds:
    """This worker's encoder for the vocabulary file at ``path``."""
    return kept(("byte ids", path), lambda: ByteIds(path))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
