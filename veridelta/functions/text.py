"""Text functions: normal forms, tokens, numbers, chunks, claims and seeds, as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUNCTUATION = string.punctuation
ARTICLES = ("a", "an", "the")
TOKEN = "([A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*)"
NUMBER = r"(-?\d+\.?\d*%?)"
#: Unicode white space.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE = WHITE + "+"
ANSWER_IS = rf"(?:so{WHITE}+)?(?:the{WHITE}+)?(?:final{WHITE}+)?answer{WHITE}+is{WHITE}*[:\-]?{WHITE}*"
ANSWER_PREFIX = rf"(?iu)^{ANSWER_IS}"
SENTENCE_END = rf"[.!?][\"']?(?={WHITE}|\z)"
SPECIAL_TOKEN = r"^(?:</?s>|<\|[^>]+\|>|\[(?:INST|/INST)\])$"
#: Signs of which a token without content consists.
SIGNS = ".,;:!?()-[]{}\"'`\n\t /\\|"
# Words that carry no content.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought
to of in for on with at by from as into through during before after above below between out off over under again further
then once here there when where why how all each every both few more most other some such no not only own same so than too
very just because but and or if while although this that these those it its i me my we our you your he him his she her
they them their what which who whom whose
""".split()


#: An article that no letter, digit or underscore touches.
ARTICLE = r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])"


def stripped(text: Column) -> Column:
    """The text without the Unicode white space that it begins and ends with."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def articles_first(text: Column) -> Column:
    """Lower case, articles to spaces, punctuation removed, white space collapsed."""
    text = F.regexp_replace(F.lower(text), ARTICLE, " ")
    return _collapsed(F.translate(text, PUNCTUATION, ""))


def punctuation_first(text: Column) -> Column:
    """Lower case, punctuation removed, articles to spaces, white space collapsed."""
    text = F.translate(F.lower(text), PUNCTUATION, "")
    return _collapsed(F.regexp_replace(text, ARTICLE, " "))


def plain_tokens(text: Column) -> Column:
    """The words of the punctuation-first form: split at white space, without articles."""
    words = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), SPACE)
    return F.filter(words, lambda w: ~w.isin("", *ARTICLES))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bound(f, **columns: Column) -> Column:
    """``f`` of some columns, each computed once however often ``f`` uses it."""
    once = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return F.transform(once, lambda s: f(*(s[n] for n in columns)))[0]


def running_sums(sizes: Column, block: int = 64) -> Column:
    """Zero and the sums of an array of numbers up to each place: within blocks first, then over the blocks, so that the
    arrays which grow by one stay short."""

    def inclusive(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))

        def step(s: Column, n: Column) -> Column:
            at = (s["at"] + n).cast("int")
            return F.struct(at.alias("at"), F.concat(s["sums"], F.array(at)).alias("sums"))

        return F.aggregate(xs, start, step, lambda s: s["sums"])

    def over_blocks(inner: Column) -> Column:
        totals = inclusive(F.transform(inner, lambda xs: F.get(xs, F.size(xs) - 1)))
        before = F.slice(F.concat(F.array(F.lit(0)), totals), F.lit(1), F.size(inner))
        shifted = F.zip_with(inner, before, lambda xs, b: F.transform(xs, lambda x: x + b))
        return F.concat(F.array(F.lit(0)), F.flatten(shifted))

    def split(own: Column) -> Column:
        blocks = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(block))).otherwise(
            F.array().cast("array<int>")
        )
        return bound(over_blocks, inner=F.transform(blocks, lambda b: inclusive(F.slice(own, b, block))))

    return bound(split, own=sizes)


def word_runs(text: Column, n: int) -> Column:
    """Every run of n words."""

    def runs(own: Column) -> Column:
        last = F.size(own) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, n), " "))

    return bound(runs, own=words(text))


def tokens(text: Column) -> Column:
    """ASCII word tokens with inner quotes and hyphens, lower-cased afterwards."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1)), lambda t: F.lower(t))


def numbers(text: Column) -> Column:
    """The numbers in a text; a percentage is divided by 100."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(1))
    return F.transform(
        found,
        lambda n: F.when(n.endswith("%"), F.rtrim(n, F.lit("%")).cast("double") / 100).otherwise(n.cast("double")),
    )


def chunks(text: Column, size: int = 256, overlap: int = 32) -> Column:
    """Overlapping windows of words; the last is the first that reaches the end."""
    step = size - overlap

    def windows(own: Column) -> Column:
        n = F.size(own)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(step))).cast("int")
        starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda s: F.array_join(F.slice(own, s + 1, size), " "))

    return bound(windows, own=words(text))


def sentence_claims(text: Column, least: int = 10) -> Column:
    """Claims without a model: sentences longer than ``least`` characters, without outer white space."""
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), stripped), lambda s: F.length(s) > least
    )


def _kept(items: Column) -> Column:
    return F.filter(F.transform(items, stripped), lambda x: x.isNotNull() & (x != ""))


def _claims_of_object(text: Column) -> Column:
    """The claims of a JSON object, if all are strings: none where it has no such key; null for anything else."""
    listed = F.get_json_object(text, "$.claims")
    # as JSON again: a string's item is quoted, whatever its content
    strict = F.from_json(listed, "array<variant>")
    all_strings = F.forall(strict, lambda v: F.schema_of_variant(v) == "STRING")
    whole = F.try_parse_json(text)
    no_key = F.schema_of_variant(whole).startswith("OBJECT<") & F.try_variant_get(whole, "$.claims", "variant").isNull()
    none = F.array().cast("array<string>")
    return F.when(all_strings, _kept(F.from_json(listed, "array<string>"))).when(no_key, none)


def _claims_of_list(text: Column) -> Column:
    """The items of the first brackets that hold anything, as a JSON list of any values; null where they aren't one."""
    found = F.from_json(F.regexp_extract(text, r"\[[^\]]+\]", 0), "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    said = F.transform(
        found,
        lambda v: F.when(v.isNull() | (kind(v) == "VOID"), "None")
        .when(kind(v) == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .otherwise(F.try_variant_get(v, "$", "string")),
    )
    return _kept(said)


def claims(text: Column) -> Column:
    """Claims of a model's answer: ``{"claims": [...]}`` if all are strings, else the first list in it, else its sentences."""
    return F.coalesce(_claims_of_object(text), _claims_of_list(text), sentence_claims(text))


def standalone_claims(answer: Column, text: Column) -> Column:
    """Claims of a model's answer about ``text``, which is the claim itself where sentences were looked for and none found;
    none if it is blank."""
    none = F.array().cast("array<string>")
    sentences = sentence_claims(answer)
    own = F.when(F.size(sentences) > 0, sentences).otherwise(F.array(text))
    return F.when(stripped(text) == "", none).otherwise(
        F.coalesce(_claims_of_object(answer), _claims_of_list(answer), own)
    )


def is_key_token(token: Column) -> Column:
    """Whether a token carries content: more than one character, not all signs, no stop word."""
    bare = F.lower(stripped(token))
    return (F.length(bare) > 1) & (F.translate(bare, SIGNS, "") != "") & ~bare.isin(STOP_WORDS)


def display_decoded(token: Column) -> Column:
    """A token's text from the form that tokenizers show; special tokens have none."""
    shown = F.replace(F.replace(F.replace(token, F.lit("▁"), F.lit(" ")), F.lit("Ġ"), F.lit(" ")), F.lit("Ċ"), F.lit("\n"))
    return F.when(F.regexp_like(token, F.lit(SPECIAL_TOKEN)), "").otherwise(shown)


def first_sentence(text: Column) -> Column:
    """The text up to its first sentence's end, trimmed; whole if no sentence ends before its own end."""
    upto = F.regexp_extract(text, rf"(?s)^(.*?{SENTENCE_END})", 1)
    cut = (upto != "") & (F.length(upto) < F.length(text))
    return F.when(cut, stripped(upto)).otherwise(text)


def first_sentence_pieces(text: Column, pieces: Column) -> Column:
    """The pieces of a text, which they make up in order, that its first sentence takes; the last one is cut at its end."""
    upto = F.regexp_extract(text, rf"(?s)^(.*?{SENTENCE_END})", 1)
    end = F.when((upto != "") & (F.length(upto) < F.length(text)), F.length(upto))
    # a piece begins where the letters of all before it end
    places = F.slice(running_sums(F.transform(pieces, F.length)), F.lit(1), F.size(pieces))
    left = F.zip_with(pieces, places, lambda p, at: F.struct(p.alias("p"), (end - at).alias("left")))
    kept = F.filter(left, lambda x: x["left"] > 0)
    return F.when(end.isNull(), pieces).otherwise(
        F.transform(kept, lambda x: F.substring(x["p"], F.lit(1), F.least(x["left"], F.length(x["p"]))))
    )


def final_answer(text: Column) -> Column:
    """What follows ``answer is`` up to the text's end in the same line, without quotes around it and the last full stops;
    null if it isn't there."""
    bare = F.regexp_replace(stripped(text), r"\.+\z", "")
    found = F.regexp_extract(bare, rf"(?iu){ANSWER_IS}[\"']?([^\n]+?)[\"']?{WHITE}*\z", 1)
    return F.when(found != "", F.regexp_replace(stripped(found), r"^[\"']+|[\"']+\z", ""))


def answer_of(text: Column) -> Column:
    """The final answer, or the whole text without outer white space where none is given."""
    return F.coalesce(final_answer(text), stripped(text))


def stable_seed(seed: int, key: Column) -> Column:
    """A seed from the first 31 bits of a hash of ``seed:key``."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8)
    return F.conv(first, 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def uniform(seed: int, key: Column) -> Column:
    """A number strictly between 0 and 1 from a stable seed."""
    return (stable_seed(seed, key) + 0.5) / F.lit(float(1 << 31))
