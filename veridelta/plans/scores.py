"""Queries of uncertainties, rank statistics, calibration and control."""

from pyspark.sql import functions as F

from veridelta.operators import control, stats, uncertainty
from veridelta.plans.registry import query, table

R = lambda c: F.round(c, 6)


def _events(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return own.withColumn("logprob", -F.col("value") / 10).withColumn("day", F.dayofyear("ts") % 7)


EVENTS = """e AS (SELECT event_id, user_id, event_type, value, -value / 10 AS logprob,
  CAST(dayofyear(ts) % 7 AS INTEGER) AS day FROM events)"""
SE = """c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL),
  p AS (SELECT user_id, n, n * 1.0 / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
  s AS (SELECT user_id, -sum(p * log2(p)) AS bits, -sum(p * ln(p)) AS nats, sum(n) AS n FROM p GROUP BY user_id)"""


@query(
    "semantic_entropy",
    f"""WITH {EVENTS}, {SE} SELECT user_id, round(bits, 6) AS se_bits, round(nats, 6) AS se_nats,
      round(CASE WHEN n > 1 THEN bits / log2(n) ELSE 0 END, 6) AS se_normalised FROM s""",
)
def semantic_entropy(spark, sf_dir):
    """Entropy of event types of every user, in bits and nats and normalised."""
    own = uncertainty.entropy(_events(spark, sf_dir), ["user_id"], "event_type", F.log2, "bits")
    return own.select(
        "user_id",
        R(F.col("bits")).alias("se_bits"),
        R(F.col("bits") * F.log(F.lit(2.0))).alias("se_nats"),
        R(uncertainty.normalised(F.col("bits"), F.col("n_samples"))).alias("se_normalised"),
    )


@query(
    "posterior_scores",
    f"""WITH {EVENTS}, c AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL),
    p AS (SELECT user_id, n * 1.0 / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
    t AS (SELECT user_id, -sum(p * ln(p)) AS total, count(*) AS k FROM p GROUP BY user_id),
    d AS (SELECT user_id, day, event_type, count(*) AS n FROM e GROUP BY ALL),
    q AS (SELECT user_id, day, n * 1.0 / sum(n) OVER (PARTITION BY user_id, day) AS p FROM d),
    h AS (SELECT user_id, day, -sum(p * ln(p)) AS h FROM q GROUP BY ALL),
    w AS (SELECT user_id, avg(h) AS within FROM h GROUP BY user_id),
    a AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS mass FROM e GROUP BY user_id)
    SELECT t.user_id, round(total, 6) AS total_entropy, round(within, 6) AS generation_entropy,
      round(greatest(0, total - within), 6) AS retrieval_mi, k AS n_concepts, round(mass, 6) AS anchor_mass,
      round(1 - mass, 6) AS anchor_risk FROM t JOIN w USING (user_id) JOIN a USING (user_id)""",
)
def posterior_scores(spark, sf_dir):
    """Retrieval-posterior decomposition of every user's events, days as contexts."""
    own = uncertainty.posterior_scores(
        _events(spark, sf_dir), "user_id", "day", "event_type", F.col("event_type") == "click"
    )
    rounded = ("total_entropy", "generation_entropy", "retrieval_mi", "anchor_mass", "anchor_risk")
    return own.select("user_id", "n_concepts", *[R(F.col(c)).alias(c) for c in rounded])


@query(
    "token_uncertainty",
    f"""WITH {EVENTS}, s AS (SELECT user_id, day, avg(-logprob) AS u FROM e WHERE logprob > -100 GROUP BY ALL)
    SELECT user_id, round(avg(u) / ln(2), 6) AS u_bits, round(avg(u) / log2(exp(1)), 6) AS u_legacy FROM s GROUP BY user_id""",
)
def token_uncertainty(spark, sf_dir):
    """Token uncertainty of every user, days as samples, in bits and by the older divisor."""
    own = _events(spark, sf_dir)
    bits = uncertainty.token_uncertainty(own, "user_id", "day", "logprob")
    older = uncertainty.token_uncertainty(own, "user_id", "day", "logprob", legacy=True)
    older = older.withColumnRenamed("u_token", "older")
    return bits.join(older, "user_id").select("user_id", R("u_token").alias("u_bits"), R("older").alias("u_legacy"))


@query(
    "perplexity",
    f"""WITH {EVENTS} SELECT user_id, event_type, round(-avg(logprob), 6) AS nll, round(exp(-avg(logprob)) / 1e3, 4) AS ppl_thousands,
      round(1 - exp(max(logprob)), 6) AS p_true_uncertainty FROM e GROUP BY ALL""",
)
def perplexity(spark, sf_dir):
    """Negative log-likelihood, perplexity and affirmative uncertainty of every user's event types."""
    by = ["user_id", "event_type"]
    own = uncertainty.perplexity(_events(spark, sf_dir), by, "logprob")
    best = _events(spark, sf_dir).groupBy(*by).agg(F.max("logprob").alias("best"))
    return own.join(best, by).select(
        *by,
        R("nll").alias("nll"),
        F.round(F.col("ppl") / 1e3, 4).alias("ppl_thousands"),
        R(uncertainty.p_true_uncertainty(F.col("best"))).alias("p_true_uncertainty"),
    )


@query(
    "cluster_mass",
    f"""WITH {EVENTS}, m AS (SELECT user_id, event_type, logprob, max(logprob) OVER (PARTITION BY user_id) AS m FROM e),
    s AS (SELECT user_id, event_type, sum(exp(logprob - m)) AS s FROM m GROUP BY ALL),
    l AS (SELECT user_id, event_type, ln(s / sum(s) OVER (PARTITION BY user_id)) AS l FROM s)
    SELECT user_id, round(-sum(exp(l) * l), 6) AS semantic_entropy, round(max(l), 6) AS largest FROM l GROUP BY user_id""",
)
def cluster_mass(spark, sf_dir):
    """Probability-weighted semantic entropy of every user's events."""
    masses = uncertainty.cluster_mass(_events(spark, sf_dir), "user_id", "event_type", "logprob")
    largest = masses.groupBy("user_id").agg(F.max("log_mass").alias("l"))
    own = uncertainty.weighted_entropy(masses, "user_id").join(largest, "user_id")
    return own.select("user_id", R("semantic_entropy").alias("semantic_entropy"), R("l").alias("largest"))


def _profiles(spark, sf_dir):
    own = _events(spark, sf_dir)
    se = uncertainty.entropy(own, ["user_id"], "event_type", F.log2, "se")
    u = uncertainty.token_uncertainty(own, "user_id", "day", "logprob")
    first = own.where("day <= 2")
    se0 = uncertainty.entropy(first, ["user_id"], "event_type", F.log2, "se0")
    u0 = uncertainty.token_uncertainty(first, "user_id", "day", "logprob").withColumnRenamed("u_token", "u0")
    return se.select("user_id", "se").join(u, "user_id").join(se0.select("user_id", "se0"), "user_id").join(u0, "user_id")


def _entropy_sql(name, where):
    return f"""{name} AS (SELECT user_id, -sum(p * log2(p)) AS v FROM (SELECT user_id, n * 1.0 / sum(n) OVER
      (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, count(*) AS n FROM e {where} GROUP BY ALL)) GROUP BY user_id)"""


def _token_sql(name, where):
    return f"""{name} AS (SELECT user_id, avg(u) / ln(2) AS v FROM (SELECT user_id, day, avg(-logprob) AS u
      FROM e {where} GROUP BY ALL) GROUP BY user_id)"""


PROFILES = f"""{EVENTS}, {_entropy_sql('a', '')}, {_token_sql('b', '')}, {_entropy_sql('a0', 'WHERE day <= 2')},
  {_token_sql('b0', 'WHERE day <= 2')}, f AS (SELECT a.user_id, round(a.v, 6) AS se, round(b.v, 6) AS u, round(a0.v, 6) AS se0,
  round(b0.v, 6) AS u0 FROM a JOIN b USING (user_id) JOIN a0 USING (user_id) JOIN b0 USING (user_id))"""


@query(
    "routing",
    f"""WITH {PROFILES} SELECT user_id,
      CASE WHEN se > 2.2 THEN 'RETRIEVE' WHEN u > 7 THEN 'PRUNE' ELSE 'STOP' END AS fixed,
      CASE WHEN se > greatest(CAST(0.99 AS DOUBLE) * se0, 0.2) THEN 'RETRIEVE'
        WHEN u > greatest(CAST(0.9 AS DOUBLE) * u0, 0.2) THEN 'PRUNE' ELSE 'STOP' END AS adaptive,
      round(greatest(0, 1 - se), 6) AS confidence, se > 2.0 AS escalates FROM f""",
)
def routing(spark, sf_dir):
    """Decisions for every user by fixed thresholds and by those of the first days."""
    own = _profiles(spark, sf_dir).select(
        "user_id", R("se").alias("se"), R("u_token").alias("u"), R("se0").alias("se0"), R("u0").alias("u0")
    )
    se, u = F.col("se"), F.col("u")
    by_first = control.route(
        se, u, control.adaptive_threshold(F.col("se0"), 0.99, 0.2), control.adaptive_threshold(F.col("u0"), 0.9, 0.2)
    )
    return own.select(
        "user_id",
        control.route(se, u, F.lit(2.2), F.lit(7.0)).alias("fixed"),
        by_first.alias("adaptive"),
        R(control.confidence(se)).alias("confidence"),
        control.escalates(se, 2.0).alias("escalates"),
    )


@query(
    "threshold_grid",
    f"""WITH {PROFILES}, g AS (SELECT CAST(s AS DOUBLE) AS tau_semantic, CAST(t AS DOUBLE) AS tau_token
      FROM (SELECT unnest([1.6, 1.8, 2.0, 2.1, 2.2, 2.25, 2.3]) AS s), (SELECT unnest([4, 5, 6, 7, 8, 9, 10]) AS t))
    SELECT tau_semantic, tau_token, count(*) FILTER (WHERE se > tau_semantic) AS n_retrieve,
      count(*) FILTER (WHERE NOT se > tau_semantic AND u > tau_token) AS n_prune,
      count(*) FILTER (WHERE NOT se > tau_semantic AND NOT u > tau_token) AS n_stop FROM g, f GROUP BY ALL""",
)
def threshold_grid(spark, sf_dir):
    """How many users each pair of thresholds sends where."""
    own = _profiles(spark, sf_dir).select(R("se").alias("se"), R("u_token").alias("u"))
    pairs = control.grid(spark, [1.6, 1.8, 2.0, 2.1, 2.2, 2.25, 2.3], [4, 5, 6, 7, 8, 9, 10])
    # 49 pairs, a fixed number
    met = own.crossJoin(F.broadcast(pairs)).withColumn(
        "d", control.route(F.col("se"), F.col("u"), F.col("tau_semantic"), F.col("tau_token"))
    )
    count = lambda d: F.count(F.when(F.col("d") == d, 1))
    return met.groupBy("tau_semantic", "tau_token").agg(
        count("RETRIEVE").alias("n_retrieve"), count("PRUNE").alias("n_prune"), count("STOP").alias("n_stop")
    )


@query(
    "convergence",
    f"""WITH {EVENTS}, d AS (SELECT user_id, day, round(avg(value), 6) AS v FROM e GROUP BY ALL),
    w AS (SELECT *, lag(v, 2) OVER (PARTITION BY user_id ORDER BY day) AS b,
      min(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM d)
    SELECT user_id, day, coalesce(b = 0 OR m >= b * (1 - CAST(0.05 AS DOUBLE)), false) AS converged FROM w""",
)
def convergence(spark, sf_dir):
    """Whether every user's daily mean has stopped falling."""
    days = _events(spark, sf_dir).groupBy("user_id", "day").agg(R(F.avg("value")).alias("v"))
    return control.converged(days, "user_id", "day", "v", 2, 0.05).select("user_id", "day", "converged")


@query(
    "flare_trigger",
    f"""WITH {EVENTS}, t AS (SELECT user_id, day, list(event_type || ' ' ORDER BY event_id) AS p, list(logprob ORDER BY event_id) AS l FROM e GROUP BY ALL)
    SELECT user_id, day, len(list_filter(l, lambda x: x <= ln(0.2))) > 0 AS triggered,
      coalesce(nullif(trim(regexp_replace(array_to_string(list_transform(range(1, len(p) + 1),
        lambda i: CASE WHEN l[i] > ln(0.05) THEN p[i] ELSE ' ' END), ''), '\\s+', ' ', 'g')), ''), 'question') AS query,
      round(exp(list_min(l)), 6) AS least_probability FROM t""",
)
def flare_trigger(spark, sf_dir):
    """Retrieval trigger and masked query of every user's day, events as pieces."""
    own = _events(spark, sf_dir).groupBy("user_id", "day").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "event_type", "logprob"))).alias("t")
    )
    pieces, lps = F.transform("t", lambda x: F.concat(x["event_type"], F.lit(" "))), F.col("t.logprob")
    return own.select(
        "user_id",
        "day",
        control.triggers(lps, pieces, 0.2).alias("triggered"),
        control.masked_query(pieces, lps, 0.05, F.lit("question")).alias("query"),
        R(F.exp(F.array_min(lps))).alias("least_probability"),
    )


@query(
    "pruning",
    f"""WITH {EVENTS}, t AS (SELECT sum(value) AS s, user_id FROM e GROUP BY user_id),
    x AS (SELECT e.*, round(value / 50, 6) AS score, round(s, 4) AS se, round(s - value * 0.5 + day, 4) AS se_without,
      row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS n FROM e JOIN t USING (user_id))
    SELECT event_id, CASE WHEN score >= 0.8 THEN 'keep' WHEN score <= 0.2 THEN 'drop' ELSE 'test' END AS zone,
      NOT (n <= 10 AND se_without <= se) AS kept FROM x""",
)
def pruning(spark, sf_dir):
    """Gray zones and leave-one-out decisions, events as context chunks."""
    own = _events(spark, sf_dir)
    totals = own.groupBy("user_id").agg(F.sum("value").alias("s"))
    own = own.join(totals, "user_id").select(
        "event_id",
        "user_id",
        R(F.col("value") / 50).alias("score"),
        F.round("s", 4).alias("se"),
        F.round(F.col("s") - F.col("value") * 0.5 + F.col("day"), 4).alias("se_without"),
    )
    own = control.leave_one_out(own, "user_id", "event_id", "se", "se_without", 10)
    return own.select("event_id", control.gray_zone(F.col("score"), 0.8, 0.2).alias("zone"), "kept")


@query(
    "cost_summary",
    """WITH p AS (SELECT * FROM (VALUES ('O', 2.5, 10.0), ('X', 0.15, 0.6)) AS t(model, a, b))
    SELECT l_linestatus AS model, count(*) AS n_calls, round(sum((CAST(l_quantity AS DOUBLE) * 100 * coalesce(CAST(a AS DOUBLE), 5)
      + CAST(l_linenumber AS DOUBLE) * 10 * coalesce(CAST(b AS DOUBLE), 15)) / 1e6), 2) AS cost
    FROM lineitem LEFT JOIN p ON l_linestatus = model GROUP BY l_linestatus""",
)
def cost_summary(spark, sf_dir):
    """Costs by model, line items as calls."""
    prices = spark.createDataFrame(
        [("O", 2.5, 10.0), ("X", 0.15, 0.6)], "model string, price_in double, price_out double"
    )
    calls = table(spark, sf_dir, "lineitem").select(
        "l_linestatus",
        (F.col("l_quantity").cast("double") * 100).alias("tokens_in"),
        (F.col("l_linenumber").cast("double") * 10).alias("tokens_out"),
    )
    own = control.call_costs(calls, F.broadcast(prices), "l_linestatus", "tokens_in", "tokens_out")
    return own.groupBy(F.col("l_linestatus").alias("model")).agg(
        F.count("*").alias("n_calls"), F.round(F.sum("cost"), 2).alias("cost")
    )


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    own = table(spark, sf_dir, "labels").join(docs, "doc_id")
    other = F.pmod(F.col("doc_id") * 7919, F.lit(1009)).cast("double")
    return own.select("doc_id", "lang", (F.col("quality") == 0).alias("bad"), F.col("n_chars").cast("double").alias("a"), other.alias("b"))


SCORED = """x AS (SELECT doc_id, lang, quality = 0 AS bad, CAST(n_chars AS DOUBLE) AS a,
  CAST((doc_id * 7919) % 1009 AS DOUBLE) AS b FROM labels JOIN documents USING (doc_id))"""


@query(
    "midranks",
    f"WITH {SCORED} SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0 AS midrank FROM x",
)
def midranks(spark, sf_dir):
    """Ranks of document lengths within each language, ties at their mean."""
    return stats.midranks(_scored(spark, sf_dir), "a", ["lang"]).select("doc_id", "lang", "midrank")


@query(
    "auroc",
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0 AS m FROM x),
    s AS (SELECT lang, sum(m) FILTER (WHERE bad) AS m, count(*) FILTER (WHERE bad) AS p, count(*) FILTER (WHERE NOT bad) AS n FROM r GROUP BY lang)
    SELECT lang, round(CASE WHEN p > 0 AND n > 0 THEN (m - p * (p + 1) / 2.0) / (p * n) END, 6) AS auroc,
      p AS n_positive, n AS n_negative FROM s""",
)
def auroc(spark, sf_dir):
    """How well document length tells bad from good, in each language."""
    own = stats.auroc(_scored(spark, sf_dir), "a", "bad", ["lang"])
    return own.select("lang", R("auroc").alias("auroc"), "n_positive", "n_negative")


@query(
    "delong",
    f"""WITH {SCORED}, k AS (SELECT count(*) FILTER (WHERE bad) AS p, count(*) FILTER (WHERE NOT bad) AS n FROM x),
    r AS (SELECT *,
      rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS za,
      rank() OVER (PARTITION BY bad ORDER BY a) + (count(*) OVER (PARTITION BY bad, a) - 1) / 2.0 AS xa,
      rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS zb,
      rank() OVER (PARTITION BY bad ORDER BY b) + (count(*) OVER (PARTITION BY bad, b) - 1) / 2.0 AS xb FROM x),
    v AS (SELECT bad, CASE WHEN bad THEN (za - xa) / n ELSE 1 - (za - xa) / p END AS va,
      CASE WHEN bad THEN (zb - xb) / n ELSE 1 - (zb - xb) / p END AS vb, p, n FROM r, k),
    t AS (SELECT avg(va) FILTER (WHERE bad) AS aa, avg(vb) FILTER (WHERE bad) AS ab,
      var_samp(va - vb) FILTER (WHERE bad) / max(p) + var_samp(va - vb) FILTER (WHERE NOT bad) / max(n) AS var FROM v),
    u AS (SELECT *, (aa - ab) / sqrt(var) AS z, abs((aa - ab) / sqrt(var)) AS y FROM t)
    SELECT round(aa, 6) AS auc_a, round(ab, 6) AS auc_b, round(aa - ab, 6) AS difference, round(z, 4) AS z,
      round(1 - 2 * exp(-y * y / 2) / sqrt(2 * pi()) * list_reduce(range(1, 300),
        lambda a, i: [a[1] * y * y / (2 * i + 1), a[2] + a[1] * y * y / (2 * i + 1)], [y, y])[2], 6) AS p_value FROM u""",
)
def delong(spark, sf_dir):
    """Paired test of two scores over all labelled documents."""
    own = stats.delong(_scored(spark, sf_dir), "a", "b", "bad")
    return own.select(*[R(c).alias(c) for c in ("auc_a", "auc_b", "difference")], F.round("z", 4).alias("z"), R("p_value").alias("p_value"))


BINS = f"""{SCORED}, y AS (SELECT round(b / 1008, 4) AS c, CAST(NOT bad AS DOUBLE) AS y FROM x),
  g AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin),
  z AS (SELECT bin, count(c) AS n, coalesce(avg(c), 0) AS confidence, coalesce(avg(y), 0) AS accuracy
    FROM g LEFT JOIN y ON c >= bin * CAST(0.1 AS DOUBLE) AND (c < (bin + 1) * CAST(0.1 AS DOUBLE) OR bin = 9) GROUP BY bin)"""


def _bins(spark, sf_dir):
    own = _scored(spark, sf_dir).select(F.round(F.col("b") / 1008, 4).alias("c"), (~F.col("bad")).alias("y"))
    return stats.calibration_bins(own, "c", "y")


@query(
    "calibration_bins",
    f"WITH {BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy), 6) AS gap FROM z",
)
def calibration_bins(spark, sf_dir):
    """Confidence and accuracy by bin."""
    return _bins(spark, sf_dir).select("bin", "n", *[R(c).alias(c) for c in ("confidence", "accuracy", "gap")])


@query(
    "calibration_error",
    f"WITH {BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece, round(max(abs(confidence - accuracy)), 6) AS mce FROM z",
)
def calibration_error(spark, sf_dir):
    """Expected and maximum calibration error."""
    return stats.calibration_error(_bins(spark, sf_dir)).select(R("ece").alias("ece"), R("mce").alias("mce"))
