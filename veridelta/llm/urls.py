"""Operator 7: URL rules, with block decisions carried over redirect equivalence. Native: no Python on the executors.

A page gets the verdict of the longest rule that fits its url. A page without one is blocked if a url that is its alias,
over redirects (``<meta http-equiv=refresh>``) and canonical links, is blocked by a rule; a rule that allows a page
always stands. Aliases are the connected components of those links. Urls are the same alias if they agree in their normal
form: scheme and host in lower case, no default port, no fragment, ``/`` for an empty path, no dot segments. Links are
resolved against their page's url; links of other kinds (``mailto:``) are none.

A page whose url is null or has no ``://`` has an empty host and path, fits no rule, and is allowed. Null and empty html
has no links; html of any length is searched whole. Rows without a page_id are judged like others; repeated rows are
judged alike; an empty table gives no rows. Only page_id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.llm.common import read
from veridelta.operators.components import connected_components

#: (verdict, host, path): the rules of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What follows the first ``://``: the host, then the path.
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A tag with ``canonical`` among its rels; a tag that redirects; their targets.
CANONICAL = (
    r"(?is)<link\b[^>]*\brel\s*=\s*"
    r"(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?:[\s/][^>]*)?>)[^>]*>?"
)
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
#: An absolute url: scheme, host, path, query.
WHOLE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AFTER, 2)


def judged(df: DataFrame, url: str, rules=RULES) -> DataFrame:
    """``df`` with host, path, rule and ruled, the longest fitting rule and its verdict, null where none fits."""
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = ruled = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    up = F.lit("..")
    kept = F.aggregate(
        parts,
        F.lit([]).cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def normal_url(url: Column) -> Column:
    """A url's normal form; null for what has no scheme and ``://``."""
    part = lambda k: F.regexp_extract(url, WHOLE, k)
    scheme, host = F.translate(part(1), UPPER, LOWER), F.translate(part(2), UPPER, LOWER)
    port = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(
        scheme == "https", F.regexp_replace(host, ":(443)?$", "")
    )
    path = F.when(part(3) == "", F.lit("/")).otherwise(_without_dots(part(3)))
    whole = F.concat(scheme, F.lit("://"), F.coalesce(port, host), path, part(4))
    return F.when(scheme != "", whole)


def _absolute(link: Column, base: Column) -> Column:
    """A link as written on the page at ``base``, made absolute; null for what is no link to a page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.regexp_like(link, F.lit(SCHEME + "//")), link)
        .when(F.regexp_like(link, F.lit(SCHEME)), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(folder, link))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): redirects and canonical links of the pages, as urls in normal form."""

    def links(tag: str, value: str) -> Column:
        tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.replace(F.regexp_extract(t, value, 1), F.lit("&amp;"), F.lit("&")))

    found = pages.where(F.col(url).contains("://")).select(
        F.col(url).alias("src"), F.explode(F.concat(links(CANONICAL, HREF), links(REFRESH, TARGET))).alias("link")
    )
    found = found.where("link <> ''").select("src", _absolute(F.col("link"), F.col("src")).alias("dst"))
    return found.select(normal_url(F.col("src")).alias("src"), normal_url(F.col("dst")).alias("dst")).where("src <> dst")


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """(alias_url): every url in a component of which some url is blocked by a rule."""
    members = connected_components(edges, "src", "dst")
    bad = judged(members, "node", rules).where("ruled = 'block'").select("component").distinct()
    return members.join(bad, "component", "left_semi").select(F.col("node").alias("alias_url"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    aliases = blocked_aliases(link_edges(pages), rules)
    rows = judged(pages.select("page_id", "url"), "url", rules).withColumn("asked", normal_url(F.col("url")))
    # a ruled page needs no lookup, and one without a url has none: only the others are moved to their url's aliases
    settled = F.col("ruled").isNotNull() | F.col("asked").isNull()
    passing = rows.where(settled).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict")
    )
    open_ = rows.where(~settled).join(aliases, F.col("asked") == F.col("alias_url"), "left")
    by_alias = F.when(F.col("alias_url").isNotNull(), "block").otherwise("allow")
    return passing.unionByName(open_.select("page_id", "host", "path", "rule", by_alias.alias("verdict")))


def op7_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(read(spark, sf_dir, "pages"))


def _sql_normal(url: str) -> str:
    """The SQL of ``normal_url``."""
    part = lambda k: f"regexp_extract({url}, '{WHOLE}', {k})"
    scheme, host, path = f"translate({part(1)}, '{UPPER}', '{LOWER}')", f"translate({part(2)}, '{UPPER}', '{LOWER}')", part(3)
    parts = f"str_split(substr({path}, 2), '/')"
    kept = f"""list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform({parts}, lambda x: [x])), lambda done, x:
      CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN done[1:greatest(len(done) - 1, 0)] ELSE list_concat(done, x) END)"""
    last = f"CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END"
    return f"""CASE WHEN {part(1)} <> '' THEN concat({scheme}, '://',
      CASE {scheme} WHEN 'http' THEN regexp_replace({host}, ':(80)?$', '') WHEN 'https' THEN regexp_replace({host}, ':(443)?$', '')
        ELSE {host} END,
      CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN '/' || array_to_string(list_concat({kept}, {last}), '/')
        ELSE {path} END, {part(4)}) END"""


def _sql() -> str:
    fits = [
        f"SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p" for v, h, p in RULES
    ]
    quoted = lambda pattern: pattern.replace("\\\"", "\"").replace("'", "''")
    parts = """regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1) AS raw_host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path"""
    return f"""
WITH RECURSIVE rules AS ({' UNION ALL '.join(fits)}),
found AS (
  SELECT url AS src, replace(unnest(list_concat(
    list_transform(regexp_extract_all(coalesce(html, ''), '{quoted(CANONICAL)}'), lambda t: regexp_extract(t, '{quoted(HREF)}', 1)),
    list_transform(regexp_extract_all(coalesce(html, ''), '{quoted(REFRESH)}'), lambda t: regexp_extract(t, '{quoted(TARGET)}', 1)))),
    '&amp;', '&') AS link
  FROM pages WHERE contains(url, '://')),
based AS (
  SELECT src, link, regexp_extract(src, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) AS root,
    regexp_extract(src, '(?s)^([^?#]*)', 1) AS page, rtrim(regexp_extract(src, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') || '/' AS folder
  FROM found WHERE link <> ''),
whole AS (
  SELECT src, CASE WHEN regexp_matches(link, '{SCHEME}//') THEN link WHEN regexp_matches(link, '{SCHEME}') THEN NULL
    WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN root || link
    WHEN starts_with(link, '?') THEN page || link WHEN starts_with(link, '#') THEN src ELSE folder || link END AS dst FROM based),
links AS (
  SELECT src, dst FROM (SELECT {_sql_normal('src')} AS src, {_sql_normal('dst')} AS dst FROM whole) WHERE src <> dst),
both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
reach(url, alias) AS (
  SELECT src, dst FROM both_ways
  UNION
  SELECT r.url, b.dst FROM reach r JOIN both_ways b ON r.alias = b.src),
urls AS (SELECT url AS u FROM pages UNION SELECT alias FROM reach),
parts AS (SELECT u, coalesce(raw_host, '') AS raw_host, coalesce(path, '') AS path FROM (SELECT u, {parts} FROM urls)),
lowered AS (SELECT u, translate(raw_host, '{UPPER}', '{LOWER}') AS host, path FROM parts),
fitting AS (
  SELECT l.u, h || p AS rule, v, row_number() OVER (PARTITION BY l.u ORDER BY length(h || p) DESC) AS n
  FROM lowered l JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT u, rule, v FROM fitting WHERE n = 1),
bad AS (SELECT DISTINCT r.url FROM reach r JOIN best b ON r.alias = b.u AND b.v = 'block'),
asked AS (SELECT page_id, url, {_sql_normal('url')} AS own FROM pages)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN b.v IS NOT NULL THEN b.v WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM asked LEFT JOIN lowered l ON l.u = asked.url LEFT JOIN best b ON b.u = asked.url LEFT JOIN bad ON bad.url = asked.own
"""


SQL = _sql()
