"""Queries of key tokens, sentences, pieces and masked queries of generated texts, and of prompt layouts."""

from pyspark.sql import functions as F

from veridelta.functions import align, layout, text
from veridelta.operators import control, uncertainty
from veridelta.plans.registry import query, table
from veridelta.plans.texts import SPLIT, stripped

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
SIGNS = text.SIGNS.replace("'", "''")
TURNS = "v AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
#: Pieces: words with the white space after them.
PIECE = r"\S+\s*|\s+"
PIECES = rf"{TURNS}, p AS (SELECT *, regexp_extract_all(text, '{PIECE}') AS p FROM v)"
#: The stand-in log-probability of a piece: by its length.
LOGPROB = "ln((len({x}) % 7 + 1) / 8.0)"


def key(x: str) -> str:
    return f"len({x}) > 1 AND translate({x}, '{SIGNS}', '') <> '' AND {x} NOT IN ({STOP})"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _pieces(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("p", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)))
    return rows.withColumn("l", F.transform("p", lambda x: F.log((F.length(x) % 7 + 1) / 8.0)))


@query(
    "key_tokens",
    f"""WITH {TURNS}, k AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, {SPLIT}), lambda x: lower(x)),
      lambda x: {key('x')}) AS k FROM v)
    SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS n_key, md5(array_to_string(k, ' ')) AS key_md5 FROM k""",
)
def key_tokens(spark, sf_dir):
    """The tokens of every turn that carry content."""
    k = F.filter(text.words(F.col("text")), text.is_key_token)
    own = _turns(spark, sf_dir).select("conv_id", "turn", F.transform(k, lambda x: F.lower(x)).alias("k"))
    return own.select("conv_id", "turn", F.size("k").alias("n_key"), F.md5(F.array_join("k", " ")).alias("key_md5"))


@query(
    "key_token_uncertainty",
    f"""WITH {PIECES}, x AS (SELECT conv_id, turn, unnest(p) AS piece FROM p),
    b AS (SELECT conv_id, turn, lower({stripped('piece')}) AS b, {LOGPROB.format(x='piece')} AS l FROM x),
    s AS (SELECT conv_id, turn, avg(-l / ln(2)) AS u FROM b WHERE {key('b')} GROUP BY ALL),
    u AS (SELECT conv_id, avg(u) AS u FROM s GROUP BY conv_id)
    SELECT q.conv_id, round(coalesce(u, 0), 6) AS u_token FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN u USING (conv_id)""",
)
def key_token_uncertainty(spark, sf_dir):
    """Token uncertainty of every conversation over its key tokens, 0 where it has none."""
    rows = _pieces(spark, sf_dir)
    tokens = rows.select("conv_id", "turn", F.explode(F.arrays_zip("p", "l")).alias("x")).select("conv_id", "turn", "x.p", "x.l")
    own = uncertainty.token_uncertainty(tokens, "conv_id", "turn", "l", token="p", questions=rows)
    return own.select("conv_id", F.round("u_token", 6).alias("u_token"))


SENTENCE = rf"{PIECES}, e AS (SELECT *, regexp_extract(text, '(?s)^(.*?[.!?][\"'']?)(\s|$)', 1) AS upto FROM p), " + (
    "c AS (SELECT *, upto <> '' AND len(upto) < len(text) AS cut FROM e)"
)


@query(
    "first_sentences",
    f"""WITH {SENTENCE}, k AS (SELECT *, CASE WHEN cut THEN list_filter(list_transform(range(1, len(p) + 1), lambda i:
        substr(p[i], 1, greatest(0, CAST(len(upto) - coalesce(list_sum(list_transform(p[1 : i - 1], lambda x: len(x))), 0) AS BIGINT)))),
        lambda x: x <> '') ELSE p END AS kept FROM c)
    SELECT conv_id, turn, md5(CASE WHEN cut THEN regexp_replace(upto, '^\\s+|\\s+$', '', 'g') ELSE text END) AS sentence_md5,
      CAST(len(kept) AS INTEGER) AS n_pieces, md5(array_to_string(kept, '|')) AS pieces_md5 FROM k""",
)
def first_sentences(spark, sf_dir):
    """The first sentence of every turn, and the pieces that it takes."""
    return _pieces(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.md5(text.first_sentence(F.col("text"))).alias("sentence_md5"),
        F.size(text.first_sentence_pieces(F.col("text"), F.col("p"))).alias("n_pieces"),
        F.md5(F.array_join(text.first_sentence_pieces(F.col("text"), F.col("p")), "|")).alias("pieces_md5"),
    )


#: Of every third turn, the pieces lack their last one, and a byte is wrong.
SPOILT = "(conv_id + turn) % 3 = 0"


@query(
    "piece_alignment",
    rf"""WITH {PIECES}, o AS (SELECT conv_id, turn, {stripped('text')} AS bare, {SPOILT} AS spoilt,
      CASE WHEN {SPOILT} THEN p[1 : len(p) - 1] ELSE p END AS p FROM p),
    w AS (SELECT *, array_to_string(p, '') AS whole FROM o),
    m AS (SELECT *, {stripped('whole')} = bare AS exact, len(whole) AS total,
      list_transform(range(0, len(p) + 1), lambda i: CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) AS BIGINT)) AS ends FROM w),
    s AS (SELECT *, len(whole) - len(regexp_replace(whole, '^{text.SPACE}', '')) AS low FROM m),
    c AS (SELECT *, CASE WHEN exact THEN list_transform(ends, lambda e: least(greatest(e - low, 0), len(bare)))
      WHEN total = 0 THEN list_transform(range(0, len(p) + 1), lambda i: CASE WHEN i = len(p) THEN len(bare) ELSE 0 END)
      ELSE list_transform(ends, lambda e: CAST(round_even(len(bare) * e / total, 0) AS BIGINT)) END AS cuts FROM s),
    d AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: substr(bare, cuts[i] + 1, cuts[i + 1] - cuts[i])) AS pieces FROM c)
    SELECT conv_id, turn, exact, md5(array_to_string(pieces, '|')) AS pieces_md5, CAST(len(p) AS INTEGER) AS n_pieces,
      NOT spoilt OR len(bare) = 0 AS bytes_exact,
      md5(CASE WHEN spoilt THEN '' ELSE array_to_string(regexp_extract_all(bare, '(?s).'), '') END) AS bytes_md5 FROM d""",
)
def piece_alignment(spark, sf_dir):
    """The pieces of every turn against its text without outer white space, by characters and by bytes; those of every third
    turn don't fit."""
    spoilt, cores = F.expr(SPOILT), spark.sparkContext.defaultParallelism
    rows = _pieces(spark, sf_dir)
    # much work on little input: a few files would be a few tasks
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    rows = rows.withColumn("bare", text.stripped(F.col("text")))
    p = F.when(spoilt, F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0)))).otherwise(F.col("p"))
    # each byte of a text as a token of its own: characters of several bytes are spread over tokens
    byte = F.transform(F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    rows = rows.withColumn("values", F.transform(byte, lambda b: F.array(F.when(spoilt, b.bitwiseXOR(F.lit(1))).otherwise(b))))
    rows = rows.withColumn("by_text", align.aligned_to_text(F.col("bare"), p))
    rows = rows.withColumn("by_bytes", align.aligned_to_bytes(F.col("bare"), F.transform("values", lambda _: F.lit("x")), F.col("values")))
    joined = lambda c, by: F.md5(F.array_join(F.col(f"{c}.pieces"), by))
    return rows.select(
        "conv_id", "turn", F.col("by_text.exact").alias("exact"), joined("by_text", "|").alias("pieces_md5"),
        F.size("by_text.pieces").alias("n_pieces"), F.col("by_bytes.exact").alias("bytes_exact"), joined("by_bytes", "").alias("bytes_md5"),
    )


@query(
    "masked_queries",
    rf"""WITH {PIECES}, m AS (SELECT conv_id, turn, p, array_to_string(list_transform(p, lambda x:
        CASE WHEN {LOGPROB.format(x='x')} > ln(0.4) THEN x ELSE ' ' END), '') AS m FROM p),
    q AS (SELECT *, trim(regexp_replace(m, {SPLIT}, ' ', 'g'), ' ') AS q FROM m),
    r AS (SELECT *, regexp_replace(trim(regexp_replace(q, '(?i)^(?:so\s+)?(?:the\s+)?(?:final\s+)?answer\s+is\s*[:\-]?\s*', ''), ' '),
      '^[."'']+|[."'']+$', '', 'g') AS r FROM q)
    SELECT conv_id, turn, md5(CASE WHEN r <> '' THEN r ELSE 'question ' || conv_id END) AS query_md5,
      round(list_min(list_transform(p, lambda x: (len(x) % 7 + 1) / 8.0)), 6) AS least,
      len(list_filter(p, lambda x: {stripped('x')} <> '' AND (len(x) % 7 + 1) / 8.0 <= 0.2)) > 0 AS triggered FROM r""",
)
def masked_queries(spark, sf_dir):
    """The search text that is left of every turn without its uncertain pieces, its least probability and its trigger."""
    p, l = F.col("p"), F.col("l")  # noqa: E741
    asked = F.concat(F.lit("question "), F.col("conv_id"))
    return _pieces(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.md5(control.masked_query(p, l, 0.4, asked)).alias("query_md5"),
        F.round(control.min_probability(l), 6).alias("least"),
        control.triggers(l, p, 0.2).alias("triggered"),
    )


@query(
    "truth_prompts",
    f"""WITH {TURNS}, a AS (SELECT conv_id, list(text ORDER BY turn, text) AS t FROM v GROUP BY conv_id),
    b AS (SELECT conv_id, t[1] AS q, t[len(t)] AS y, t[2 : len(t) - 1] AS s FROM a),
    c AS (SELECT *, list_transform(list_append(s, y), lambda x: {stripped('x')} || chr(10)) AS l,
      list_transform(list_prepend(y, s), lambda x: {stripped('x')} || ' ' || chr(10)) AS k FROM b)
    SELECT conv_id, md5('Question: ' || q || chr(10) || 'Brainstormed Answers: ' || array_to_string(l, '') || 'Possible answer: ' || y
      || chr(10) || 'Is the possible answer:' || chr(10) || 'A) True' || chr(10) || 'B) False' || chr(10) || 'The possible answer is:') AS prompt_md5,
      md5('Question: ' || q || chr(10) || 'Brainstormed Answers: ' || array_to_string(k, '') || 'Possible answer: ' || y
      || chr(10) || 'Is the possible answer:' || chr(10) || 'A) True' || chr(10) || 'B) False' || chr(10) || 'The possible answer is: B') AS shot_md5 FROM c""",
)
def truth_prompts(spark, sf_dir):
    """Every conversation as a question with answers, open and as a worked example."""
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    t, n = F.col("t.text"), F.size("t")
    q, y, s = F.get(t, F.lit(0)), F.get(t, n - 1), F.slice(t, F.lit(2), F.greatest(n - 2, F.lit(0)))
    return rows.select(
        "conv_id",
        F.md5(layout.truth_prompt(q, y, s)).alias("prompt_md5"),
        F.md5(layout.truth_shot(q, y, s, F.lit(False))).alias("shot_md5"),
    )


@query(
    "rationales",
    """WITH u AS (SELECT user_id, round(count(DISTINCT event_type) / 10.0, 4) AS se, round(avg(value) / 100, 4) AS u FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN se > 0.3 THEN 'RETRIEVE' WHEN u > 0.2 THEN 'PRUNE' ELSE 'STOP' END AS decision,
      CASE WHEN se > 0.3 THEN printf('semantic entropy %.4f is above %.4f: new evidence is needed', se, 0.3)
        WHEN u > 0.2 THEN printf('semantic entropy %.4f is at most %.4f but token uncertainty %.4f is above %.4f: the context needs pruning', se, 0.3, u, 0.2)
        ELSE printf('semantic entropy %.4f is at most %.4f and token uncertainty %.4f at most %.4f: the answer is certain', se, 0.3, u, 0.2) END AS reason
    FROM u""",
)
def rationales(spark, sf_dir):
    """What is decided for every user, and why."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(F.count_distinct("event_type") / 10.0, 4).alias("se"), F.round(F.avg("value") / 100, 4).alias("u")
    )
    own = rows.select("user_id", control.rationale(F.col("se"), F.col("u"), F.lit(0.3), F.lit(0.2)).alias("r"))
    return own.select("user_id", "r.decision", "r.reason")
