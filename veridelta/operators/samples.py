"""Claims and key tokens of drawn samples, and search by claims. Models are given: functions that build them, as in hooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.layout import filled
from veridelta.functions.text import claims, is_key_token, stripped
from veridelta.operators import hooks
from veridelta.operators.retrieval import claim_queries, dense_top_k

#: The kinds of content that have a template of their own, and those that share the images'.
TABLE, IMAGE = ("table",), ("image", "multimodal")


def claim_prompt(text: Column, modality: Column, templates: dict[str, str]) -> Column:
    """The prompt that asks for a text's claims: the template ``table``, ``image`` or, for any other or no modality, ``text``,
    with the text in place of ``{text}``."""
    chosen = F.when(modality.isin(*TABLE), templates["table"]).when(modality.isin(*IMAGE), templates["image"])
    return filled(chosen.otherwise(templates["text"]), text=text)


def claims_by_model(
    samples: DataFrame, text: str, modality: Column, templates: dict[str, str], build: Callable[[], Callable], batch: int = 64
) -> DataFrame:
    """``samples`` with ``claims`` and ``error``. The model gets prompts, each distinct one once, and gives answers: JSON,
    a list in a text, or sentences. A null answer leaves the text itself as the one claim. Blank texts have no claims and are
    never asked about; a null text is blank. A prompt that fails has null claims and its error."""
    has = stripped(F.coalesce(F.col(text), F.lit(""))) != ""
    asked = samples.where(has).withColumn("__prompt", claim_prompt(F.col(text), modality, templates))

    def one() -> Callable:
        model = build()
        return lambda rows: model([prompt for (prompt,) in rows])

    answered = hooks.scored(asked, ["__prompt"], one, "string", "__answer", batch)
    found = F.when(F.col("__answer").isNotNull(), claims(F.col("__answer"))).when(F.col("error").isNull(), F.array(text))
    answered = answered.select(*samples.columns, found.alias("claims"), "error")
    none = samples.where(~has).withColumn("claims", F.array().cast("array<string>"))
    return answered.unionByName(none.withColumn("error", F.lit(None).cast(dict(answered.dtypes)["error"])))


def key_tokens(tokens: Column) -> Column:
    """Of an array of structs with ``token``, those that carry content; none where the array is null."""
    kept = F.filter(tokens, lambda t: F.coalesce(is_key_token(t["token"]), F.lit(False)))
    return F.coalesce(kept, F.array())


def extract_all(
    samples: DataFrame,
    text: str,
    tokens: str,
    modality: Column,
    templates: dict[str, str],
    build: Callable[[], Callable],
    batch: int = 64,
) -> DataFrame:
    """``samples`` with ``claims``, ``error`` and ``key_tokens``: their claims by a model, and the tokens that carry content."""
    return claims_by_model(samples, text, modality, templates, build, batch).withColumn("key_tokens", key_tokens(F.col(tokens)))


def claim_search(
    hypotheses: DataFrame,
    items: DataFrame,
    existing: DataFrame,
    query: str,
    item: str,
    vector: str,
    encode: Callable[[], Callable],
    k: int | None = None,
    top_k: int = 5,
    near: float = 0.95,
) -> DataFrame:
    """(query, rank, item, score): new items for each question's leading claims (query, claims).

    The claims, joined, are the search text; the encoder, built once a worker, makes each distinct text's vector. Items that
    ``existing`` (query, item, vector) holds or is near to are skipped. ``k`` goes before the settings' ``top_k``; none and 0
    leave that. Without claims, or without items, nothing is found."""
    asked = claim_queries(hypotheses, query, "claims")

    def one() -> Callable:
        model = encode()
        return lambda rows: model([text for (text,) in rows])

    vectors = hooks.scored(asked, ["text"], one, "array<double>", "__vector")
    # an encoder that fails is an error of the search: a question without its vector would seem to find nothing
    failed = F.raise_error(F.concat(F.lit("no vector: "), F.coalesce("error.message", F.lit("null")))).cast("array<double>")
    vectors = vectors.select(query, F.coalesce("__vector", failed).alias(vector))
    return dense_top_k(vectors, items, existing, query, item, vector, k or top_k, near)
