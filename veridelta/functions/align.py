"""Token pieces brought in line with the text that they make up, as Column expressions.

A generated text and its tokens come separately: the tokens as shown by a tokenizer, or as bytes, in which one character may
be spread over several. The result has one piece of the text per token, and whether the pieces are exact. The work is in
proportion to the text: pieces are cut from arrays of characters or from each other, never by counting from a text's start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridelta.functions.text import SPACE, SPECIAL_TOKEN, bound, running_sums, stripped

#: White space of one byte.
WHITE = r"[\x09-\x0D\x20]"
#: Bytes are shown as the characters of ISO-8859-1. No UTF-8 has these two: one ends a token, one is in place of no byte.
END, NO_BYTE = "\xff", "\xfe"
#: A first byte and up to three that go on with its character, and the ends of tokens between them.
CHARACTER = "([\xc0-\xfd])" + rf"({END}*)([\x80-\xBF])" + rf"(?:({END}*)([\x80-\xBF]))?" * 2


def _between(text: Column, ends: Column) -> Column:
    """The parts of a text between each two neighbours of an array of places."""

    def of(characters: Column, ends: Column) -> Column:
        n = F.size(ends) - 1
        pairs = F.arrays_zip(F.slice(ends, F.lit(1), n).alias("a"), F.slice(ends, F.lit(2), n).alias("b"))
        return F.transform(pairs, lambda p: F.array_join(F.slice(characters, p["a"] + 1, p["b"] - p["a"]), ""))

    return bound(of, characters=F.split(text, ""), ends=ends)


def _result(pieces: Column, exact: Column) -> Column:
    return F.struct(pieces.alias("pieces"), exact.alias("exact"))


def aligned_to_text(text: Column, pieces: Column) -> Column:
    """(pieces, exact) of decoded pieces.

    Exact where the pieces make up the text but for white space around their whole, which the pieces then lose. Else the text
    is dealt out in proportion to the pieces' lengths; to the last piece where all are empty."""

    def of(text: Column, pieces: Column) -> Column:
        def cut(text: Column, whole: Column, pieces: Column, ends: Column, low: Column, high: Column, size: Column) -> Column:
            last = F.size(pieces)
            placed = F.arrays_zip(
                pieces.alias("p"), F.slice(ends, F.lit(1), last).alias("a"), F.slice(ends, F.lit(2), last).alias("b")
            )
            first = lambda x: F.greatest(low - x["a"], F.lit(0))
            upto = lambda x: F.least(x["b"], F.greatest(low, high)) - x["a"]
            own = F.transform(placed, lambda x: F.substring(x["p"], first(x) + 1, F.greatest(upto(x) - first(x), F.lit(0))))
            total = F.get(ends, last)
            # without any length the last piece has it all
            share = lambda e, i: F.when(total > 0, F.bround(size.cast("long") * e / total)).when(i == last, size).otherwise(0)
            dealt = _between(text, F.transform(ends, lambda e, i: share(e, i).cast("int")))
            return bound(lambda exact: _result(F.when(exact, own).otherwise(dealt), exact), exact=stripped(whole) == text)

        def measured(text: Column, whole: Column, pieces: Column, ends: Column) -> Column:
            return bound(
                cut,
                text=text,
                whole=whole,
                pieces=pieces,
                ends=ends,
                low=F.length(F.regexp_extract(whole, f"^{SPACE}", 0)),
                high=F.length(F.regexp_replace(whole, rf"{SPACE}\z", "")),
                size=F.length(text),
            )

        ends = running_sums(F.transform(pieces, F.length))
        return bound(measured, text=text, whole=F.array_join(pieces, ""), pieces=pieces, ends=ends)

    none = F.array().cast("array<string>")
    return bound(of, text=F.coalesce(text, F.lit("")), pieces=F.coalesce(pieces, none))


def aligned_to_bytes(text: Column, tokens: Column, values: Column) -> Column:
    """(pieces, exact) of tokens and their bytes (arrays of numbers, or null).

    A character belongs to the token that has its last byte; special tokens have none. White space around the whole is cut.
    Without all bytes, or where they aren't the text's, every piece is empty."""

    def of(text: Column, tokens: Column, values: Column) -> Column:
        none = F.array().cast("array<int>")
        # the two signs that a special token begins with are looked for first, which is cheaper than the pattern
        special = lambda t: (t.startswith("<") | t.startswith("[")) & F.regexp_like(t, F.lit(SPECIAL_TOKEN))
        own = F.zip_with(tokens, values, lambda t, v: F.when(special(t), none).otherwise(v.cast("array<int>")))
        shown = lambda b: F.when(b.between(0, 254), F.chr(b)).otherwise(F.lit(NO_BYTE))

        def cut(raw: Column, exact: Column) -> Column:
            # the ends of tokens within a character go before it, so that the token with its last byte has it
            moved = F.regexp_replace(raw, CHARACTER, "$2$4$6$1$3$5$7")
            bare = lambda x: F.regexp_replace(x, rf"\G({END}*){WHITE}", "$1")
            parts = F.split(F.reverse(bare(F.reverse(bare(moved)))), END)
            pieces = F.transform(parts, lambda x: F.decode(F.encode(x, "ISO-8859-1"), "UTF-8"))
            # the text of no tokens has one part, too
            pieces = F.slice(pieces, F.lit(1), F.size(tokens))
            return _result(F.when(exact, pieces).otherwise(F.transform(tokens, lambda _: F.lit(""))), exact)

        def measured(own: Column, raw: Column) -> Column:
            complete = (F.size(tokens) == F.size(values)) & F.forall(own, lambda v: v.isNotNull())
            bare = F.regexp_replace(F.replace(raw, F.lit(END), F.lit("")), rf"^{WHITE}+|{WHITE}+\z", "")
            return bound(cut, raw=raw, exact=complete & (bare == F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")))

        def joined(own: Column) -> Column:
            raw = F.array_join(F.transform(own, lambda v: F.array_join(F.transform(v, shown), "")), END)
            return bound(measured, own=own, raw=raw)

        return bound(joined, own=own)

    return bound(
        of,
        text=F.coalesce(text, F.lit("")),
        tokens=F.coalesce(tokens, F.array().cast("array<string>")),
        values=F.coalesce(values, F.array().cast("array<array<int>>")),
    )
