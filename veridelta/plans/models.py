"""Queries of contexts with a chunk left out, of models as hooks, and of slices in a stated order."""

from pyspark.sql import functions as F

from veridelta.functions.text import plain_tokens
from veridelta.operators import hooks, leaveout, slices, uncertainty
from veridelta.plans.registry import query, table
from veridelta.plans.texts import ANSWERS, _answers, _plain


def _chunks(spark, sf_dir):
    """Events as chunks of their user's context, their types as concepts; each with the entropy of all of them."""
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    whole = uncertainty.entropy(own, ["user_id"], "event_type").select("user_id", F.round("entropy", 6).alias("se"))
    rows = own.join(whole, "user_id")
    return rows.withColumns({"score": F.round(F.col("value") / 50, 6), "against": F.round(F.col("value") / 60, 6)})


def _evaluate(tests, contexts):
    """The concept entropy of each context; an empty one has none."""
    se = uncertainty.entropy(contexts, ["user_id", "left_out"], "event_type").select(
        "user_id", "left_out", F.round("entropy", 6).alias("se")
    )
    own = tests.join(se, ["user_id", "left_out"], "left")
    return own.select("user_id", "left_out", F.coalesce("se", F.lit(0.0)).alias("se_without"))


def _sql(candidate: str, tested: str, most: int | None, last: str) -> str:
    entropy = "-sum(n * 1.0 / t * log2(n * 1.0 / t))"
    limit = "" if most is None else f" WHERE p <= {most}"
    return f"""WITH s AS (SELECT user_id, round({entropy} + 0.0, 6) AS se FROM
      (SELECT user_id, n, sum(n) OVER (PARTITION BY user_id) AS t FROM
        (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) GROUP BY user_id),
    c AS (SELECT event_id, user_id, event_type, se, round(value / 50, 6) AS score, round(value / 60, 6) AS against
      FROM events JOIN s USING (user_id)),
    k AS (SELECT * FROM c WHERE {candidate}),
    t AS (SELECT user_id, event_id AS left_out FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p
      FROM k WHERE {tested}){limit}),
    n AS (SELECT t.user_id, left_out, event_type, count(*) AS n FROM t JOIN k ON k.user_id = t.user_id AND event_id <> left_out GROUP BY ALL),
    w AS (SELECT user_id, left_out, round({entropy} + 0.0, 6) AS se_without FROM
      (SELECT *, sum(n) OVER (PARTITION BY user_id, left_out) AS t FROM n) GROUP BY ALL),
    v AS (SELECT t.user_id, t.left_out AS event_id, coalesce(se_without, 0.0) AS se_without FROM t LEFT JOIN w USING (user_id, left_out)),
    x AS (SELECT c.*, se_without, v.event_id IS NOT NULL AND se_without <= se AS noise FROM c LEFT JOIN v USING (user_id, event_id))
    {last}"""


@query(
    "leave_one_out_contexts",
    _sql("true", "true", 10, "SELECT event_id, se, se_without, NOT noise AS kept FROM x"),
)
def leave_one_out_contexts(spark, sf_dir):
    """The first ten events of every user, each left out once: the entropy without it, and whether it stays."""
    own = leaveout.prefix_caching(_chunks(spark, sf_dir), "user_id", "event_id", "se", _evaluate, 10)
    return own.select("event_id", "se", "se_without", "kept")


@query(
    "two_phase_contexts",
    _sql(
        "against < 0.8",
        "true",
        10,
        """SELECT event_id, se_without, against < 0.8 AND NOT noise AS kept, CASE WHEN against >= 0.8 THEN 'contradiction'
      WHEN se_without IS NOT NULL THEN 'leave_one_out' ELSE 'untested' END AS phase FROM x""",
    ),
)
def two_phase_contexts(spark, sf_dir):
    """Events that contradict go; the first ten others are left out of these others."""
    own = leaveout.two_phase(_chunks(spark, sf_dir), "user_id", "event_id", "se", _evaluate, "against", 0.8, 10)
    return own.select("event_id", "se_without", "kept", "phase")


@query(
    "gray_zone_contexts",
    _sql(
        "score > 0.2",
        "score < 0.8",
        None,
        """SELECT event_id, se_without, zone, zone = 'keep' OR zone = 'test' AND NOT noise AS kept FROM
      (SELECT *, CASE WHEN score >= 0.8 THEN 'keep' WHEN score <= 0.2 THEN 'drop' ELSE 'test' END AS zone FROM x)""",
    ),
)
def gray_zone_contexts(spark, sf_dir):
    """Events between the thresholds are left out of the kept and the other tested ones."""
    own = leaveout.gray_zone(_chunks(spark, sf_dir), "user_id", "event_id", "se", _evaluate, "score", 0.8, 0.2)
    return own.select("event_id", "se_without", "zone", "kept")


def _term_overlap():
    """A stand-in for an entailment model: the share of the hypothesis' distinct words that the premise has."""

    def model(rows):
        return [len(set(h) & set(p)) / len(set(h)) if h else 0.0 for p, h in rows]

    return model


@query(
    "entailment_hook",
    f"""WITH {ANSWERS}, w AS (SELECT conv_id, turn, {_plain('prediction')} AS p, {_plain('gold')} AS g FROM a),
    s AS (SELECT conv_id, turn, list_distinct(p) AS p, list_distinct(g) AS g FROM w),
    d AS (SELECT conv_id, turn, 'answer' AS premise, p, g FROM s UNION ALL SELECT conv_id, turn, 'gold', g, p FROM s)
    SELECT conv_id, turn, premise, round(CASE WHEN len(g) > 0 THEN len(list_intersect(p, g)) * 1.0 / len(g) ELSE 0 END, 6) AS entailment FROM d""",
)
def entailment_hook(spark, sf_dir):
    """Every answer against its gold answer in both directions, by a batched model that scores distinct pairs only."""
    own = _answers(spark, sf_dir).select("conv_id", "turn", plain_tokens(F.col("prediction")).alias("p"), plain_tokens(F.col("gold")).alias("g"))
    way = lambda said, a, b: F.struct(F.lit(said).alias("premise"), F.col(a).alias("p"), F.col(b).alias("g"))
    pairs = own.select("conv_id", "turn", F.explode(F.array(way("answer", "p", "g"), way("gold", "g", "p"))).alias("x"))
    pairs = pairs.select("conv_id", "turn", "x.*")
    scores = hooks.scored(pairs, ["p", "g"], _term_overlap, "double", "entailment", batch=32)
    return scores.select("conv_id", "turn", "premise", F.round("entailment", 6).alias("entailment"))


@query(
    "ordered_slice",
    """SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (ORDER BY source, doc_id) AS r FROM
      (SELECT doc_id, source, lang, row_number() OVER (ORDER BY source, doc_id) - 1 AS p FROM documents)
      WHERE p >= 100 AND p < 800 AND lang <> 'fr') WHERE r <= 300""",
)
def ordered_slice(spark, sf_dir):
    """Offset and size in the order of source and id over the whole table, then a filter, then a limit: the slice is the
    feature."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return slices.sliced(docs, "source", "doc_id", offset=100, size=700, where=F.col("lang") != "fr", limit=300)
