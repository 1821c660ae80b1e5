"""URL filter with redirect equivalence (operator 1).

A url is judged by the longest rule that fits its host (the rule's host or a
subdomain) and path prefix.  Urls tied by redirect or canonical-link edges are
aliases of one resource: connected components over those edges carry a block
from any explicitly blocked member to every alias that no rule names.  An
explicit allow always stands: an allowed url is never blocked by its aliases.

Edges come from the pages themselves (``<link rel=canonical>`` and
``<meta http-equiv=refresh>``; every such tag, relative targets, bare queries
and dot segments resolved) and, if given, from a table of crawled redirects.  Targets that were not crawled are judged by the
rules too.  A node is host, path and query: scheme and fragment do not make
another resource.

Rules are joined by equality on (host suffix, path prefix), one candidate per
suffix and distinct prefix length, so their number is not limited; urls are
judged once each, however many pages share one.

Defined cases: a null url or one without ``://`` has empty host and path, no
rule, no aliases and is allowed; null html has no edges; repeated rows give
repeated results; long html is searched whole; a page with several canonical
tags is an alias of all their targets; two rules of equal length that fit cannot both be longest
unless equal, then block wins; empty table: empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import read_table
from glossa.llm.components import components
from glossa.session import cut_lineage

# The rules of the contract query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical\b)[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_URL_PARTS = r"^([^/?#]*://[^/?#]*)([^?#]*)(.*)$"
_DOTS = r"(?:^|/)\.\.?(?:/|$)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """Identity of the resource: host, path and query (null if the url has no ``://``)."""
    return F.when(url.contains("://"), F.md5(F.concat(host(url), F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1))))


def without_dots(url: Column) -> Column:
    """An absolute url whose path has its ``.`` and ``..`` segments resolved; ``..`` at the root stays there."""
    part = lambda i: F.regexp_extract(url, _URL_PARTS, i)
    segments = F.split(F.regexp_replace(part(2), "^/", ""), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(
        s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    closing = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(part(2).rlike(_DOTS), F.concat(part(1), F.lit("/"), F.array_join(kept, "/"), closing, part(3))).otherwise(url)


def resolve(target: Column, url: Column) -> Column:
    """``target`` of a link on the page ``url`` as an absolute url without dot segments; null if there is none."""
    t = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("http://"), host(url))
    folder = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), r"[^/]*$", "")
    whole = (F.when((t == "") | t.startswith("#") | (host(url) == ""), F.when(t.rlike(_SCHEME), t))
             .when(t.rlike(_SCHEME), t).when(t.startswith("//"), F.concat(F.lit("http:"), t))
             .when(t.startswith("/"), F.concat(base, t)).when(t.startswith("?"), F.concat(base, F.when(path(url) == "", "/").otherwise(path(url)), t))
             .otherwise(F.concat(base, folder, t)))
    return without_dots(whole)


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): the targets of all canonical and refresh tags of every page."""
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    canonical = F.transform(tags(_CANONICAL), lambda tag: F.concat(*[F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)]))
    refresh = F.transform(tags(_REFRESH), lambda tag: F.regexp_extract(tag, _URL, 1))
    found = pages.select("url", F.explode(F.concat(canonical, refresh)).alias("target")).filter("target <> ''")
    return found.select(F.col("url").alias("from_url"), resolve(F.col("target"), F.col("url")).alias("to_url"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(r_host, r_path, rule, action) of rules written ``host/path-prefix``."""
    df = spark.createDataFrame(list(rules), "action string, rule string")
    return df.select(F.substring_index("rule", "/", 1).alias("r_host"), F.expr("substring(rule, instr(rule, '/'))").alias("r_path"), "rule", "action")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (distinct column ``url``) plus ``rule`` and ``action`` of the longest rule that fits, else nulls."""
    # distinct lengths of path prefixes: no more than the longest url has characters
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    split = urls.withColumns({"labels": F.split(host(F.col("url")), r"\."), "p": path(F.col("url"))})
    suffix = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    prefix = F.array_compact(F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths])) if lengths else F.array(F.lit(""))
    tried = split.select("url", F.explode(suffix).alias("suffix"), prefix.alias("prefixes")).select("url", "suffix", F.explode("prefixes").alias("prefix"))
    fits = tried.join(rules, (F.col("suffix") == F.col("r_host")) & (F.col("prefix") == F.col("r_path")))
    best = fits.groupBy(F.col("url").alias("b_url")).agg(F.max(F.struct(F.length("rule").alias("n"), "action", "rule")).alias("best"))
    return urls.join(best, F.col("url") == F.col("b_url"), "left").select("url", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, rule, ``direct`` (the rule's action) and ``verdict`` for every row of ``pages`` (page_id, url, html)."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = cut_lineage(links.filter("from_url is not null and to_url is not null").distinct())
    urls = pages.select("url").unionByName(links.select(F.col("to_url").alias("url"))).unionByName(
        links.select(F.col("from_url").alias("url"))).filter("url is not null").distinct()
    judged = cut_lineage(match_rules(urls, rules).withColumn("node", node(F.col("url"))))
    edges = links.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b"))
    roots = components(edges, "a", "b").withColumnRenamed("node", "c_node")
    placed = judged.join(roots, F.col("node") == F.col("c_node"), "left").withColumn("root", F.coalesce("root", "node"))
    blocked = placed.filter("action = 'block'").select(F.col("root").alias("bad")).distinct()
    verdicts = placed.join(blocked, F.col("root") == F.col("bad"), "left").select(
        F.col("url").alias("v_url"), "rule", F.col("action").alias("direct"),
        F.coalesce("action", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
    out = pages.select("page_id", "url").join(verdicts, F.col("url") == F.col("v_url"), "left")
    return out.select("page_id", "url", "rule", "direct", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op1_redirect_filter(spark, sf_dir) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    u = F.col("url")
    return judge(pages, rule_table(spark)).select("page_id", host(u).alias("host"), path(u).alias("path"), "rule", "verdict")


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SQL_HOST = "coalesce(translate(regexp_extract({u}, '://([^/?#]*)', 1), '%s', '%s'), '')" % (string.ascii_uppercase, string.ascii_lowercase)
_SQL_PATH = "coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
_SQL_NODE = "CASE WHEN contains({u}, '://') THEN " + _SQL_HOST + " || regexp_extract({u}, '://[^/?#]*([^#]*)', 1) END"

ORACLE_SQL = f"""
WITH RECURSIVE rules(action, rule, r_host, r_path) AS (
  SELECT a, r, split_part(r, '/', 1), substr(r, instr(r, '/')) FROM (VALUES {", ".join(f"('{a}', '{r}')" for a, r in RULES)}) t(a, r)),
targets AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, {_literal(_CANONICAL)}), lambda tag: concat(
      regexp_extract(tag, {_literal(_HREF)}, 1), regexp_extract(tag, {_literal(_HREF)}, 2), regexp_extract(tag, {_literal(_HREF)}, 3))),
    list_transform(regexp_extract_all(html, {_literal(_REFRESH)}), lambda tag: regexp_extract(tag, {_literal(_URL)}, 1)))) AS raw
  FROM pages),
cleaned AS (
  SELECT url, replace(trim(raw), '&amp;', '&') AS t, {_SQL_HOST.format(u='url')} AS h, {_SQL_PATH.format(u='url')} AS p
  FROM targets WHERE raw <> '' AND url IS NOT NULL),
resolved AS (
  SELECT DISTINCT url AS from_url, CASE
    WHEN regexp_matches(t, '{_SCHEME}') THEN t WHEN t = '' OR t[1] = '#' OR h = '' THEN NULL
    WHEN t[1:2] = '//' THEN 'http:' || t WHEN t[1] = '/' THEN 'http://' || h || t
    WHEN t[1] = '?' THEN 'http://' || h || CASE WHEN p = '' THEN '/' ELSE p END || t
    ELSE 'http://' || h || regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '[^/]*$', '') || t END AS to_url FROM cleaned),
parted AS (
  SELECT *, regexp_extract(to_url, {_literal(_URL_PARTS)}, 1) AS u1, regexp_extract(to_url, {_literal(_URL_PARTS)}, 2) AS u2,
    regexp_extract(to_url, {_literal(_URL_PARTS)}, 3) AS u3, string_split(regexp_replace(u2, '^/', ''), '/') AS segs FROM resolved),
folded AS (
  SELECT *, list_reduce(list_prepend(['']::VARCHAR[], list_transform(segs, lambda s: [s])), lambda a, s:
    CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END) AS kept FROM parted),
links AS (
  SELECT DISTINCT from_url, CASE WHEN regexp_matches(u2, '{_DOTS}')
    THEN u1 || array_to_string(kept, '/') || CASE WHEN len(kept) = 1 OR segs[-1] IN ('.', '..') THEN '/' ELSE '' END || u3 ELSE to_url END AS to_url
  FROM folded),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT to_url FROM links WHERE to_url IS NOT NULL),
parts AS (SELECT url, {_SQL_HOST.format(u='url')} AS host, {_SQL_PATH.format(u='url')} AS path, {_SQL_NODE.format(u='url')} AS node FROM urls),
judged AS (
  SELECT p.*, r.rule, r.action FROM parts p LEFT JOIN rules r
    ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
  QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY length(r.rule) DESC NULLS LAST, r.action DESC) = 1),
edges AS (
  SELECT {_SQL_NODE.format(u='from_url')} AS a, {_SQL_NODE.format(u='to_url')} AS b FROM links WHERE to_url IS NOT NULL),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
bad(node) AS (
  SELECT node FROM judged WHERE action = 'block' AND node IS NOT NULL
  UNION SELECT w.b FROM bad JOIN ways w ON w.a = bad.node)
SELECT g.page_id, {_SQL_HOST.format(u='g.url')} AS host, {_SQL_PATH.format(u='g.url')} AS path, j.rule,
  coalesce(j.action, CASE WHEN j.node IN (SELECT node FROM bad WHERE node IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages g LEFT JOIN judged j ON g.url = j.url
"""
