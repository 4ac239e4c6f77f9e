"""Queries of the text functions and answer metrics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridelta.functions import layout, metrics, text
from veridelta.plans.registry import query, table

# Pieces of SQL that several queries share.
PUNCT = text.PUNCTUATION.replace("'", "''")
#: White space as the rule has it: every sign that Unicode calls so.
SPLIT = f"'{text.SPACE}'"


def stripped(column: str) -> str:
    """The SQL of a text without its outer white space."""
    return f"regexp_replace({column}, '^{text.SPACE}|{text.SPACE}$', '', 'g')"


WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), {SPLIT}), lambda w: w <> '')"


def _plain(column: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(translate(lower(coalesce({column}, '')), '{PUNCT}', ''), {SPLIT}), "
        "lambda w: w NOT IN ('', 'a', 'an', 'the'))"
    )


@query(
    "chunk_words",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
    n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 256 THEN 1
      ELSE CAST(ceil((len(w) - 256) / 224.0) AS BIGINT) + 1 END AS n FROM w),
    c AS (SELECT doc_id, w, unnest(range(0, n)) AS i FROM n)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index,
      CAST(least(256, len(w) - i * 224) AS INTEGER) AS n_words,
      md5(array_to_string(w[i * 224 + 1 : i * 224 + 256], ' ')) AS chunk_md5 FROM c""",
)
def chunk_words(spark, sf_dir):
    """Overlapping word windows of every document."""
    chunks = F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "chunk")
    return table(spark, sf_dir, "documents").select("doc_id", chunks).select(
        "doc_id", "chunk_index", F.size(F.split("chunk", " ")).alias("n_words"), F.md5("chunk").alias("chunk_md5")
    )


@query(
    "tokenise",
    f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct,
      md5(array_to_string(t, ' ')) AS tokens_md5
    FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''),
      '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*'), lambda x: lower(x)) AS t FROM documents)""",
)
def tokenise(spark, sf_dir):
    """Word tokens of every document."""
    own = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return own.select(
        "doc_id",
        F.size("t").alias("n_tokens"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
    )


@query(
    "number_extraction",
    r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '-?[0-9]+\.?[0-9]*%?')) AS s FROM documents)
    SELECT doc_id, count(*) AS n_numbers, round(sum(CASE WHEN ends_with(s, '%')
      THEN CAST(rtrim(s, '%') AS DOUBLE) / 100 ELSE CAST(s AS DOUBLE) END) / 1e6, 4) AS total_millions
    FROM n GROUP BY doc_id""",
)
def number_extraction(spark, sf_dir):
    """The numbers in every document."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.numbers(F.col("text"))).alias("n"))
    return own.groupBy("doc_id").agg(
        F.count("*").alias("n_numbers"), F.round(F.sum("n") / 1e6, 4).alias("total_millions")
    )


def _answers(spark, sf_dir):
    """Each assistant turn with the user turn before it as its gold answer."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    said = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    return said.join(before, ["conv_id", "turn"])


ANSWERS = """a AS (SELECT s.conv_id, s.turn, s.text AS prediction, g.text AS gold FROM conversations s
  JOIN conversations g ON g.conv_id = s.conv_id AND g.turn + 1 = s.turn WHERE s.role = 'assistant' AND g.role = 'user')"""


def _articles(column: str) -> str:
    """Articles as whole words to spaces; twice, as two in a row share the space between them."""
    once = lambda x: rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    return once(once(column))


def _collapsed(column: str) -> str:
    return f"trim(regexp_replace({column}, {SPLIT}, ' ', 'g'), ' ')"


def form_one(column: str) -> str:
    """The SQL of the articles-first form."""
    return _collapsed(f"translate({_articles(f'lower({column})')}, '{PUNCT}', '')")


def form_two(column: str) -> str:
    """The SQL of the punctuation-first form."""
    return _collapsed(_articles(f"translate(lower({column}), '{PUNCT}', '')"))


def form_words(column: str) -> str:
    return f"list_filter(str_split({form_one(f'coalesce({column}, {chr(39) * 2})')}, ' '), lambda w: w <> '')"


TOKENS = f"t AS (SELECT *, {_plain('prediction')} AS p, {_plain('gold')} AS g, {form_words('prediction')} AS p1, {form_words('gold')} AS g1 FROM a)"


def _overlap(p: str, g: str) -> str:
    count = lambda xs: f"len(list_filter({xs}, lambda y: y = x))"
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda x: least({count(p)}, {count(g)}))), 0)"


def _f1(common: str, p: str, g: str) -> str:
    return f"CASE WHEN {common} > 0 THEN 2.0 * {common} / (len({p}) + len({g})) ELSE 0 END"


#: The longest common subsequence of p1 and g1, row by row of its table.
LCS = """list_reduce(list_transform(g1, lambda y: list_transform(p1, lambda x: CAST(x = y AS BIGINT))),
  lambda old, hit: list_reduce(list_transform(range(1, len(p1) + 1), lambda i: [CASE WHEN hit[i] = 1 THEN old[i] + 1 ELSE -1 END, old[i + 1]]),
    lambda row, e: list_append(row, CASE WHEN e[1] >= 0 THEN e[1] ELSE greatest(e[2], row[len(row)]) END), [CAST(0 AS BIGINT)]),
  list_transform(range(0, len(p1) + 1), lambda i: CAST(0 AS BIGINT)))[len(p1) + 1]"""
NUMBERS = r"""list_transform(regexp_extract_all(coalesce({c}, ''), '-?[0-9]+\.?[0-9]*%?'), lambda n:
  CASE WHEN ends_with(n, '%') THEN CAST(rtrim(n, '%') AS DOUBLE) / 100 ELSE CAST(n AS DOUBLE) END)"""


@query(
    "exact_match",
    f"""WITH {ANSWERS}
    SELECT conv_id, turn, coalesce({form_one('prediction')} = {form_one('gold')}, false) AS exact,
      coalesce({form_two('prediction')} = {form_two('gold')}, false) AS exact_two,
      coalesce(contains({form_two('prediction')}, {form_two('gold')}), false) AS contained FROM a""",
)
def exact_match(spark, sf_dir):
    """Exact and containment match of answers, in both normal forms."""
    p, golds = F.col("prediction"), F.array("gold")
    return _answers(spark, sf_dir).select(
        "conv_id",
        "turn",
        metrics.exact_match(p, golds).alias("exact"),
        metrics.exact_match(p, golds, text.punctuation_first).alias("exact_two"),
        metrics.containment(p, golds).alias("contained"),
    )


@query(
    "token_f1",
    f"""WITH {ANSWERS}, {TOKENS}, c AS (SELECT *, {_overlap('p1', 'g1')} AS c1, {_overlap('p', 'g')} AS common FROM t)
    SELECT conv_id, turn, round({_f1('c1', 'p1', 'g1')}, 6) AS f1,
      round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1 ELSE {_f1('common', 'p', 'g')} END, 6) AS f1_single FROM c""",
)
def token_f1(spark, sf_dir):
    """Token F1 of answers: with the best gold in one form, and with a single gold in the other."""
    p, g = F.col("prediction"), F.col("gold")
    return _answers(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.round(metrics.token_f1(p, F.array(g)), 6).alias("f1"),
        F.round(metrics.token_f1_single(p, g), 6).alias("f1_single"),
    )


@query(
    "rouge_l",
    f"""WITH {ANSWERS}, {TOKENS}, c AS (SELECT *, CASE WHEN len(p1) > 0 AND len(g1) > 0 THEN {LCS} ELSE 0 END AS common FROM t)
    SELECT conv_id, turn, round({_f1('common', 'p1', 'g1')}, 6) AS rouge_l FROM c""",
)
def rouge_l(spark, sf_dir):
    """ROUGE-L of answers."""
    return _answers(spark, sf_dir).select(
        "conv_id", "turn", F.round(metrics.rouge_l(F.col("prediction"), F.array("gold")), 6).alias("rouge_l")
    )


@query(
    "metric_suite",
    f"""WITH {ANSWERS}, {TOKENS}, n AS (SELECT *, {NUMBERS.format(c='prediction')} AS pn, {NUMBERS.format(c='gold')} AS gn,
      coalesce({form_one('prediction')} = {form_one('gold')}, false) AS exact FROM t),
    c AS (SELECT *, {_overlap('p1', 'g1')} AS c1, CASE WHEN len(p1) > 0 AND len(g1) > 0 THEN {LCS} ELSE 0 END AS l1,
      CASE WHEN len(pn) = 0 THEN exact ELSE len(list_filter(gn, lambda y: len(list_filter(pn, lambda x:
        abs(x - y) <= 1e-6 OR abs(x - y) <= 1e-6 * abs(y))) > 0)) > 0 END AS number FROM n)
    SELECT round(coalesce(avg(CAST(exact AS INT)), 0), 6) AS exact_match, round(coalesce(avg({_f1('c1', 'p1', 'g1')}), 0), 6) AS token_f1,
      round(coalesce(avg(CAST(number AS INT)), 0), 6) AS "numeric", round(coalesce(avg({_f1('l1', 'p1', 'g1')}), 0), 6) AS rouge_l FROM c""",
)
def metric_suite(spark, sf_dir):
    """Mean metrics of all answers, 0 where there are none."""
    p, golds = F.col("prediction"), F.array("gold")
    chosen = metrics.suite(("exact_match", "token_f1", "numeric", "rouge_l"), p, golds)
    return _answers(spark, sf_dir).agg(*[F.round(metrics.mean_or_zero(c), 6).alias(n) for n, c in chosen.items()])


@query(
    "claims_split",
    rf"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(
      regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: {stripped('x')}), lambda x: len(x) > 10) AS c
      FROM conversations)
    SELECT conv_id, turn, CAST(len(c) AS INTEGER) AS n_claims, md5(array_to_string(c, '; ')) AS claims_md5 FROM s""",
)
def claims_split(spark, sf_dir):
    """Sentence claims of every turn."""
    own = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.sentence_claims(F.col("text")).alias("c")
    )
    return own.select(
        "conv_id", "turn", F.size("c").alias("n_claims"), F.md5(layout.guidance(F.col("c"), 1 << 20)).alias("claims_md5")
    )


@query(
    "stable_seed",
    """SELECT event_id, (CAST(('0x' || substr(sha256('17:' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)
      & 2147483647) AS seed FROM events""",
)
def stable_seed(spark, sf_dir):
    """A seed for every event."""
    return table(spark, sf_dir, "events").select("event_id", text.stable_seed(17, F.col("event_id")).alias("seed"))


@query(
    "text_context",
    """SELECT conv_id, md5('Context:' || chr(10) || string_agg('[Doc ' || n || '] ' || coalesce(text, ''), chr(10) ORDER BY n))
      AS context_md5, count(*) AS n_docs
    FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations)
    GROUP BY conv_id""",
)
def text_context(spark, sf_dir):
    """The turns of every conversation as a numbered context."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return own.select(
        "conv_id",
        F.md5(layout.text_context(F.col("t.text"))).alias("context_md5"),
        F.size("t").cast("long").alias("n_docs"),
    )


@query(
    "table_layouts",
    """WITH r AS (SELECT n_regionkey, array_agg('| ' || n_nationkey || ' | ' || n_name || ' |' ORDER BY n_nationkey) AS m,
      array_agg('key: ' || n_nationkey || '; name: ' || n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(m, chr(10)) AS markdown,
      array_to_string(l, ' | ') AS linear FROM r""",
)
def table_layouts(spark, sf_dir):
    """Each region's nations as a Markdown table and in one line."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r")
    )
    headers = F.array(F.lit("key"), F.lit("name"))
    cells = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select(
        "n_regionkey",
        layout.table_markdown(headers, cells).alias("markdown"),
        layout.table_linear(headers, cells).alias("linear"),
    )


@query(
    "free_tables",
    """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders)
    SELECT k AS o_orderkey,
      CASE k % 3 WHEN 0 THEN '| priority | urgent |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p || ' | '
          || CASE WHEN p = '1-URGENT' THEN 'True' ELSE 'False' END || ' |'
        WHEN 1 THEN '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' |  |' || chr(10) || '| None | ' || s || ' |'
        ELSE 'order ' || k END AS markdown,
      CASE k % 3 WHEN 0 THEN 'priority: ' || p || '; urgent: ' || CASE WHEN p = '1-URGENT' THEN 'True' ELSE 'False' END
        WHEN 1 THEN 'key: ' || k || ' | key: None; status: ' || s ELSE 'order ' || k END AS linear FROM o""",
)
def free_tables(spark, sf_dir):
    """Each order as an object with headers and rows, a list of rows, or text: one column, laid out by one plan."""
    text = lambda x: F.to_json(F.array(x))
    one = lambda x: F.substring(text(x), F.lit(2), F.length(text(x)) - 2)
    urgent = (F.col("o_orderpriority") == "1-URGENT").cast("string")
    json = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"headers":["priority","urgent"],"rows":[['), one(F.col("o_orderpriority")), F.lit(","), urgent, F.lit("]]}")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('[["key","status"],['), F.col("o_orderkey"), F.lit("],[null,"), one(F.col("o_orderstatus")), F.lit("]]")))
        .otherwise(one(F.concat(F.lit("order "), F.col("o_orderkey"))))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(json).alias("t"))
    rows = rows.select("o_orderkey", layout.free_table(F.col("t")).alias("t"))
    return rows.select("o_orderkey", *[layout.free_layout(F.col("t"), f).alias(f) for f in ("markdown", "linear")])



@query(
    "numbered_slice",
    """SELECT doc_id, CAST(n AS INTEGER) AS place FROM (SELECT doc_id, lang,
      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n > 2 AND n <= 12 AND lang <> 'fr'""",
)
def numbered_slice(spark, sf_dir):
    """Offset and limit by place within each source, then a filter: the slice is the feature."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", place.alias("place"))
    return own.where("place > 2 and place <= 12 and lang <> 'fr'").select("doc_id", "place")
