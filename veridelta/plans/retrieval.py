"""Queries of retrieval and its evaluation."""

from pyspark.sql import functions as F

from veridelta.functions import text
from veridelta.operators import retrieval
from veridelta.plans.registry import query, table
from veridelta.plans.texts import WORDS

TOKEN = "'[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'"
BM25 = f"""w AS (SELECT doc_id, {WORDS} AS w FROM documents),
  n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 256 THEN 1
    ELSE CAST(ceil((len(w) - 256) / 224.0) AS BIGINT) + 1 END AS n FROM w),
  i AS (SELECT doc_id, w, unnest(range(0, n)) AS i FROM n),
  c AS (SELECT doc_id AS doc, i AS chunk, list_transform(regexp_extract_all(
    array_to_string(w[i * 224 + 1 : i * 224 + 256], ' '), {TOKEN}), lambda x: lower(x)) AS t FROM i),
  d AS (SELECT doc, chunk, len(t) AS dl, unnest(t) AS term FROM c),
  tf AS (SELECT doc, chunk, term, dl, count(*) AS tf FROM d GROUP BY ALL),
  z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM c),
  f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, z GROUP BY term, n),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM f) ELSE raw END AS idf FROM f),
  q AS (SELECT item_id AS query, unnest(list_transform(regexp_extract_all(coalesce(text, ''), {TOKEN}), lambda x: lower(x))) AS term FROM benchmark),
  qf AS (SELECT query, term, count(*) AS qf FROM q GROUP BY ALL),
  s AS (SELECT query, doc, chunk, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
    FROM qf JOIN idf USING (term) JOIN tf USING (term), z GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY score DESC, chunk) AS m FROM s),
  r AS (SELECT query, doc, chunk, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b WHERE m = 1),
  top AS (SELECT query, CAST(rank AS INTEGER) AS rank, doc, CAST(chunk AS INTEGER) AS chunk, score FROM r WHERE rank <= 10)"""


def _ranked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "body"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return retrieval.bm25(asked, docs, "item_id", "text", "doc_id", "chunk", "body", 10)


@query("bm25_topk", f"WITH {BM25} SELECT * FROM top")
def bm25_topk(spark, sf_dir):
    """The ten best documents of every benchmark item, each by its best chunk."""
    return _ranked(spark, sf_dir)


@query(
    "retrieval_quality",
    f"""WITH {BM25}, dg AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1)), lambda i: array_to_string(w[i : i + 7], ' '))) AS gram FROM w),
    bw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 7, 1)), lambda i: array_to_string(w[i : i + 7], ' '))) AS gram FROM bw),
    gold AS (SELECT DISTINCT item_id AS query, doc_id AS doc FROM dg JOIN bg USING (gram)),
    g AS (SELECT query, count(*) AS n FROM gold GROUP BY query),
    h AS (SELECT query, {', '.join(f'count(*) FILTER (WHERE rank <= {k}) AS h{k}' for k in (1, 2, 4, 10))}, min(rank) AS first
      FROM top JOIN gold USING (query, doc) GROUP BY query),
    x AS (SELECT n, {', '.join(f'coalesce(h{k}, 0) AS h{k}' for k in (1, 2, 4, 10))}, first FROM g LEFT JOIN h USING (query))
    SELECT {', '.join(f'round(avg(h{k} / CAST(n AS DOUBLE)), 6) AS recall_{k}, round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS success_{k}' for k in (1, 2, 4, 10))},
      round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM x""",
)
def retrieval_quality(spark, sf_dir):
    """Recall, success and reciprocal rank of the lexical search; a document that shares eight words in a row is gold."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.word_runs(F.col("text"), 8)).alias("run")).distinct()
    runs = retrieval.shared_runs(table(spark, sf_dir, "documents"), "doc_id", "text", asked, 8)
    gold = runs.join(retrieval.small(asked), "run").select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    return retrieval.retrieval_quality(_ranked(spark, sf_dir), gold, (1, 2, 4, 10))


@query(
    "cosine_topk",
    """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    n AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS s FROM u),
    q AS (SELECT * FROM n WHERE vec_id % 100 = 0),
    m AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_dot_product(q.v, i.v) / (q.s * i.s), 6) AS score,
      list_dot_product(h.v, i.v) / (h.s * i.s) AS near, h.vec_id AS had
      FROM q JOIN n h ON h.vec_id = q.vec_id + 1, n i WHERE i.vec_id <> h.vec_id),
    r AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM m WHERE near < 0.4)
    SELECT query, CAST(rank AS INTEGER) AS rank, item, score FROM r WHERE rank <= 5""",
)
def cosine_topk(spark, sf_dir):
    """The five vectors most like each hundredth one, without the next one and what is near to it."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = own.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query")
    had = asked.select("query", (F.col("query") + 1).alias("vec_id")).join(own, "vec_id")
    return retrieval.dense_top_k(asked, own, had, "query", "vec_id", "embedding", 5, near=0.4)


EVENTS = "e AS (SELECT user_id, event_id, value FROM events)"


@query(
    "retrieval_softmax",
    f"""WITH {EVENTS}, l AS (SELECT *, (value - avg(value) OVER w) / stddev_pop(value) OVER w / 0.5 AS logit FROM e WINDOW w AS (PARTITION BY user_id)),
    s AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY user_id)) AS x FROM l)
    SELECT event_id, round(logit, 6) AS logit, round(x / sum(x) OVER (PARTITION BY user_id), 6) AS probability FROM s""",
)
def retrieval_softmax(spark, sf_dir):
    """Retrieval probabilities of every user's events."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    own = retrieval.retrieval_probabilities(own, "user_id", "value", 0.5)
    return own.select("event_id", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"))


@query(
    "gumbel_sets",
    f"""WITH {EVENTS}, d AS (SELECT user_id, event_id, round(value, 4) AS logit, unnest(range(3)) AS draw FROM e),
    u AS (SELECT *, ((CAST(('0x' || substr(sha256('11:' || user_id || ':' || draw || ':' || event_id), 1, 8)) AS BIGINT) & 2147483647) + 0.5)
      / CAST(2147483648 AS DOUBLE) AS u FROM d),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id, draw ORDER BY round(logit - ln(-ln(u)), 6) DESC, event_id) AS r FROM u)
    SELECT user_id, CAST(draw AS INTEGER) AS draw, array_to_string(list(event_id ORDER BY event_id), ',') AS items FROM g WHERE r <= 4 GROUP BY ALL""",
)
def gumbel_sets(spark, sf_dir):
    """Three draws of four events of every user, without replacement."""
    own = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 4).alias("logit"))
    sets = retrieval.gumbel_sets(own, "user_id", "event_id", "logit", 4, 3, 11)
    return sets.select("user_id", "draw", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))
