"""Queries of samples: how many are drawn, their claims by a model, pairs of them, their entropies, prompts, search by claims."""

import json

from pyspark.sql import functions as F

from veridelta.functions import layout, text
from veridelta.operators import cluster, control, hooks, samples, uncertainty
from veridelta.plans.generation import LOGPROB, PIECES, TURNS, _pieces, _turns, key
from veridelta.plans.registry import query, table
from veridelta.plans.scores import EVENTS, _events
from veridelta.plans.texts import SPLIT, stripped
from veridelta.session import written
from veridelta.sources import records

TEMPLATES = {kind: f"{kind} claims: {{text}}" for kind in ("text", "table", "image")}


def _claims_model():
    """A stand-in for a model that lists claims: tables by lines as JSON, images as a list in a text, texts as sentences."""

    def model(prompts):
        kinds, said = zip(*(p.split(" claims: ", 1) for p in prompts))
        forms = {
            "table": lambda t: json.dumps({"claims": t.split("\n")}),
            "image": lambda t: "Seen: " + json.dumps([t.replace("]", ")"), 7, True, None]),
            "text": lambda t: None if "," not in t else t,
        }
        return [forms[k](t) for k, t in zip(kinds, said)]

    return model


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {stripped('x')}), lambda x: x <> '')"
SENTENCES = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {stripped('x')}), lambda x: len(x) > 10)"


@query(
    "sample_claims",
    f"""WITH {PIECES}, c AS (SELECT conv_id, turn, CASE WHEN {stripped('text')} = '' THEN CAST([] AS VARCHAR[])
        WHEN turn % 4 = 1 THEN {LINES} WHEN turn % 4 >= 2 THEN [{stripped("replace(text, ']', ')')")}, '7', 'True', 'None']
        WHEN contains(text, ',') THEN {SENTENCES} ELSE [text] END AS c, list_filter(p, lambda x: {key(f'lower({stripped("x")})')}) AS k FROM p)
    SELECT conv_id, turn, CAST(len(c) AS INTEGER) AS n_claims, md5(array_to_string(c, ' | ')) AS claims_md5, CAST(len(k) AS INTEGER) AS n_key,
      md5(array_to_string(k, '|')) AS key_md5, round(coalesce(list_sum(list_transform(k, lambda x: {LOGPROB.format(x='x')})), 0), 6) AS key_logprob FROM c""",
)
def sample_claims(spark, sf_dir):
    """The claims and key tokens of every turn, taken as a sample of text, of a table or of images by its number."""
    modality = F.element_at(F.array(*map(F.lit, ("text", "table", "image", "multimodal"))), (F.col("turn") % 4 + 1).cast("int"))
    rows = _pieces(spark, sf_dir).withColumn("tokens", F.arrays_zip(F.col("p").alias("token"), F.col("l").alias("logprob")))
    own = samples.extract_all(rows, "text", "tokens", modality, TEMPLATES, _claims_model)
    joined = lambda c, by: F.md5(F.array_join(F.col(c), by))
    total = F.aggregate("key_tokens", F.lit(0.0), lambda s, t: s + t["logprob"])
    return own.select(
        "conv_id", "turn", F.size("claims").alias("n_claims"), joined("claims", " | ").alias("claims_md5"),
        F.size("key_tokens").alias("n_key"), joined("key_tokens.token", "|").alias("key_md5"), F.round(total, 6).alias("key_logprob"),
    )


def _shared_words():
    """A stand-in for an entailment model: the share of the hypothesis' distinct words that the premise has."""

    def model(rows):
        pairs = [(set(p.split(" ")), set(h.split(" "))) for p, h in rows]
        return [len(p & h) / len(h) for p, h in pairs]

    return model


def _words(column: str) -> str:
    return f"list_distinct(string_split({column}, ' '))"


@query(
    "sample_pairs",
    f"""WITH {TURNS}, s AS (SELECT conv_id, turn, 'question ' || conv_id || ' ' || text AS t FROM v),
    w AS (SELECT *, {_words('t')} AS w FROM s),
    d AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, len(list_intersect(a.w, b.w)) * 1.0 / len(b.w) >= 0.3 AS held
      FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn)
    SELECT x.conv_id, x.i, x.j, x.held AND y.held AS equal FROM d x JOIN d y ON x.conv_id = y.conv_id AND x.i = y.j AND x.j = y.i""",
)
def sample_pairs(spark, sf_dir):
    """Every two turns of a conversation each way, under its question, equal where a batched model finds entailment both ways."""
    own = _turns(spark, sf_dir).withColumn("question", F.concat(F.lit("question "), F.col("conv_id")))
    pairs = cluster.directed_pairs(own, "conv_id", "turn", "text", "question")
    scores = hooks.scored(pairs, ["premise", "hypothesis"], _shared_words, "double", "entailment", batch=32)
    return cluster.both_entail(scores, 0.3).withColumnRenamed("query", "conv_id")


DRAWN = "unnest(range({a}, {b})) AS sample FROM u {where}"


@query(
    "samples_drawn",
    f"""WITH u AS (SELECT user_id, round(count(DISTINCT event_type) / 10.0, 4) AS se FROM events GROUP BY user_id)
    SELECT 'fixed' AS draw, user_id, CAST(sample AS INTEGER) AS sample FROM (SELECT user_id, {DRAWN.format(a=0, b=4, where='')})
    UNION ALL SELECT 'first', user_id, CAST(sample AS INTEGER) FROM (SELECT user_id, {DRAWN.format(a=0, b=3, where='')})
    UNION ALL SELECT 'more', user_id, CAST(sample AS INTEGER) FROM (SELECT user_id, {DRAWN.format(a=3, b=9, where='WHERE se > 0.5')})""",
)
def samples_drawn(spark, sf_dir):
    """The samples to draw for every user: a fixed number, the first few, and the rest where these disagree."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.count_distinct("event_type") / 10.0, 4).alias("se"))
    draws = {
        "fixed": control.samples_to_draw(users, 4, 3, 9, False),
        "first": control.samples_to_draw(users, 4, 3, 9, True),
        "more": control.samples_to_draw(users, 4, 3, 9, True, "se"),
    }
    fixed, *others = (df.select(F.lit(name).alias("draw"), "user_id", "sample") for name, df in draws.items())
    for other in others:
        fixed = fixed.unionByName(other)
    return fixed


@query(
    "response_entropies",
    f"""WITH {EVENTS}, r AS (SELECT event_type, user_id % 5 AS kind, (logprob + logprob / 2 - 1) / 3 AS l FROM e),
    g AS (SELECT event_type, -avg(l) AS regular FROM r GROUP BY ALL),
    m AS (SELECT *, max(l) OVER (PARTITION BY event_type) AS m FROM r),
    s AS (SELECT event_type, kind, sum(exp(l - m)) AS s, count(*) AS n FROM m GROUP BY ALL),
    p AS (SELECT event_type, s / sum(s) OVER w AS p, n * 1.0 / sum(n) OVER w AS q FROM s WINDOW w AS (PARTITION BY event_type)),
    h AS (SELECT event_type, -sum(p * ln(p)) AS semantic, -sum(q * ln(q)) AS assigned FROM p GROUP BY ALL)
    SELECT event_type, round(regular, 6) AS regular_entropy, round(semantic, 6) AS semantic_entropy,
      round(assigned, 6) AS cluster_assignment_entropy FROM g JOIN h USING (event_type)""",
)
def response_entropies(spark, sf_dir):
    """The three entropies of every event type, its events as responses of three tokens, its users' remainders as classes."""
    l = F.col("logprob")  # noqa: E741
    rows = _events(spark, sf_dir).select("event_type", "event_id", (F.col("user_id") % 5).alias("kind"), F.array(l, l / 2, F.lit(-1.0)).alias("l"))
    own = uncertainty.response_entropies(rows, "event_type", "event_id", "l", "kind")
    names = ("regular_entropy", "semantic_entropy", "cluster_assignment_entropy")
    return own.select("event_type", *(F.round(n, 6).alias(n) for n in names))


@query(
    "uncertainty_profile",
    f"""WITH {EVENTS}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL),
    p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM c),
    h AS (SELECT user_id, -sum(p * log2(p)) AS se, CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_kinds,
      string_agg(event_type || ':' || CAST(floor(p * 1000) AS BIGINT), ',' ORDER BY event_type) AS shares FROM p GROUP BY user_id),
    t AS (SELECT user_id, day, avg(-logprob / ln(2)) AS u FROM e GROUP BY ALL), u AS (SELECT user_id, avg(u) AS u FROM t GROUP BY user_id)
    SELECT user_id, round(se + 0.0, 6) AS se, round(u, 6) AS u_token, n_samples, n_kinds, shares FROM h JOIN u USING (user_id)""",
)
def uncertainty_profile(spark, sf_dir):
    """Both signals of every user and the shares of the types of events, in thousandths."""
    own = uncertainty.profile(_events(spark, sf_dir), _events(spark, sf_dir), "user_id", "day", "event_type", "logprob")
    share = F.transform("distribution", lambda d: F.concat_ws(":", d["event_type"], F.floor(d["probability"] * 1000).cast("string")))
    return own.select(
        "user_id", F.round("se", 6).alias("se"), F.round("u_token", 6).alias("u_token"), F.col("n_samples").cast("long").alias("n_samples"),
        F.col("n_kinds").cast("long").alias("n_kinds"), F.array_join(share, ",").alias("shares"),
    )


@query(
    "few_shots",
    """WITH n AS (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) AS n FROM documents),
    p AS (SELECT doc_id, text, sum(count(*)) OVER (ORDER BY doc_id) AS upto FROM documents GROUP BY doc_id, text),
    s AS (SELECT doc_id FROM p, n WHERE upto <= n AND length(coalesce(text, '')) % 3 > 0)
    SELECT doc_id FROM s ORDER BY CAST(('0x' || substr(sha256('5:' || doc_id), 1, 8)) AS BIGINT) & 2147483647, doc_id LIMIT 40""",
)
def few_shots(spark, sf_dir):
    """Forty of the documents with an answer in the first half, by their stable seeds: the number is the feature."""
    answers = F.when(F.length(F.coalesce("text", F.lit(""))) % 3 > 0, F.array("lang")).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", answers.alias("answers"))
    return uncertainty.few_shots(rows, "doc_id", "answers", 0.5, 40, 5).select("doc_id")


@query(
    "affirmative_tokens",
    f"""WITH {TURNS}, l AS (SELECT conv_id, turn, -(len(text) % 13 + 1) / 8.0 AS a, -(len(text) % 7 + 1) / 8.0 AS b FROM v)
    SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN b ELSE a END AS logprob,
      round(1 - exp(CASE WHEN turn % 3 = 2 THEN b ELSE a END), 6) AS uncertainty FROM l""",
)
def affirmative_tokens(spark, sf_dir):
    """The log-probability of the token A among every turn's two tokens, and what is left of its probability."""
    a, b = (-(F.length("text") % m + 1) / 8.0 for m in (13, 7))
    kinds = [F.create_map(F.lit(" A"), a, F.lit("A"), b), F.create_map(F.lit("B"), b, F.lit("▁A"), a), F.create_map(F.lit("▁B"), a, F.lit("A\n"), b)]
    tops = F.when(F.col("turn") % 3 == 0, kinds[0]).when(F.col("turn") % 3 == 1, kinds[1]).otherwise(kinds[2])
    own = _turns(spark, sf_dir).select("conv_id", "turn", uncertainty.affirmative_logprob(tops).alias("logprob"))
    return own.withColumn("uncertainty", F.round(uncertainty.p_true_uncertainty(F.col("logprob")), 6))


@query(
    "evidence_prompts",
    f"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM v),
    e AS (SELECT conv_id, string_agg('[' || (r - 1) || '] ' || role || chr(10) || text, chr(10) ORDER BY r) AS e FROM r WHERE r BETWEEN 2 AND 4 GROUP BY conv_id)
    SELECT conv_id, md5(CASE WHEN conv_id % 2 = 0 THEN 'Evidence:' || chr(10) || coalesce(e, '') || chr(10) || 'Q: ' || text
      ELSE text || ' given ' || coalesce(e, '') END) AS prompt_md5 FROM r LEFT JOIN e USING (conv_id) WHERE r = 1""",
)
def evidence_prompts(spark, sf_dir):
    """Every conversation's first turn as a question over the three next ones as evidence, in the template of its model's kind."""
    rows = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    rest = lambda c: F.slice(F.col(f"t.{c}"), F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))
    model = F.concat(F.when(F.col("conv_id") % 2 == 0, "Large-").otherwise("small-"), F.col("conv_id"))
    rows = rows.select(
        "conv_id", model.alias("model"), F.col("t.text")[0].alias("question"), layout.evidence_paragraph(rest("role"), rest("text"), 3).alias("evidence")
    )
    templates = spark.createDataFrame([("large", "Evidence:\n{evidence}\nQ: {question}"), ("small", "{question} given {evidence}")], "kind string, ask string")
    own = layout.prompts(rows, templates, "model", "ask", evidence=F.col("evidence"), question=F.col("question"))
    return own.select("conv_id", F.md5("prompt").alias("prompt_md5"))


@query("label_lookup", "SELECT doc_id, quality, toxic, lang, source FROM labels JOIN documents USING (doc_id)")
def label_lookup(spark, sf_dir):
    """Every label with its document's language and source; a label without a document is an error."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return records.looked_up(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), docs, ["doc_id"])


#: What the stand-in for an encoder counts.
LETTERS = "etaoinsrhldcumfp"


def _letter_counts():
    """A stand-in for an encoder: how often some letters stand in a text."""
    return lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts]


def _vector(column: str) -> str:
    return "[" + ", ".join(f"CAST(len({column}) - len(replace({column}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


@query(
    "claim_search",
    rf"""WITH {TURNS}, s AS (SELECT conv_id, array_to_string(c, ' ') AS t FROM (SELECT conv_id, {SENTENCES} AS c FROM v WHERE turn = 0) WHERE len(c) > 0),
    a AS (SELECT conv_id, {_vector('t')} AS v FROM s), d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
    i AS (SELECT doc_id, {_vector('x')} AS v FROM d),
    an AS (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM a), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS s FROM i),
    m AS (SELECT q.conv_id, n.doc_id, CASE WHEN q.s > 0 AND n.s > 0 THEN round(list_dot_product(q.v, n.v) / (q.s * n.s), 6) ELSE 0 END AS score
      FROM an q JOIN n ON n.doc_id <> q.conv_id LEFT JOIN n h ON h.doc_id = q.conv_id
      WHERE h.doc_id IS NULL OR h.s = 0 OR n.s = 0 OR list_dot_product(h.v, n.v) / (h.s * n.s) < 0.985),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS rank FROM m)
    SELECT conv_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 5""",
)
def claim_search(spark, sf_dir):
    """The five documents most like the claims of every conversation's first turn, without the one of its number and its like."""
    opened = _turns(spark, sf_dir).where("turn = 0")
    claims = opened.select("conv_id", text.sentence_claims(F.col("text")).alias("claims"))
    own = F.coalesce("text", F.lit(""))
    counted = F.array(*((F.octet_length(own) - F.octet_length(F.replace(own, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))
    # counted once: the search goes over them several times
    items = written(table(spark, sf_dir, "documents").select("doc_id", counted.alias("vector")), "letters")
    had = opened.select("conv_id", F.col("conv_id").alias("doc_id")).join(items, "doc_id")
    found = samples.claim_search(claims, items, had, "conv_id", "doc_id", "vector", _letter_counts, near=0.985)
    return found.select(F.col("query").alias("conv_id"), "rank", F.col("item").alias("doc_id"), "score")
