
import pytest
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards bake small round loaves near quiet rivers".split()


def passage(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + ("x" * (i % 3)) for i in range(n))


#: Every case that operators must bear: copies, near-copies, nulls, empty and long texts, repeated rows.
ROWS = [
    (0, passage(0, 60)),
    (1, passage(0, 60)),
    (2, passage(0, 59) + " elsewhere"),
    (3, passage(3, 80) + " mail jo@example.com or +1 (415) 555-0132 and 10.0.0.1, card 4111 1111 1111 1111."),
    (4, ""),
    (5, None),
    (6, "One"),
    (7, passage(5, 20_000)),
    (8, "  odd \t spaces\n\n and\x1cseparators é　中 <|endoftext|> Σ "),
    (8, "  odd \t spaces\n\n and\x1cseparators é　中 <|endoftext|> Σ "),
    (10, "you idiot scum, worthless trash"),
    (11, "1" * 3000),
    (None, "a row without an id"),
]
SCHEMA = "doc_id long, text string"


def with_clashes(df):
    """Extra columns whose names operators use inside."""
    for name in ("fp", "node", "component_id", "word", "row", "score", "start", "key", "s", "gone_id", "lang", "source"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))
