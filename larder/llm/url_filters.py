"""URL rules, and block decisions that spread over redirects and canonical links.

A rule (host, path, verdict) fits its host and all subdomains where the path starts with its path; the longest rule wins.
Urls without a rule follow their aliases: redirect edges (every ``<meta http-equiv=refresh>``) and canonical links (every
``<link rel=canonical>``) join urls into components. An alias that a rule allows takes precedence over any number
of blocked ones; otherwise one blocked alias blocks; otherwise the url is allowed. On request, urls that differ only in scheme,
``www.``/``m.``, fragment, ``utm_*`` parameters or a closing ``/`` or ``.html`` are aliases too; that is a guess, so it is off.

All work is done on distinct urls, so a url with very many rows counts once. Only expressions, joins and combined
aggregates are used.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no alias, and is allowed; null html has
no links; repeated rows are judged alike; very long urls and pages are read whole; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm.common import connected_components
from larder.session import settle

# The rules of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""


def rest(url):
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def with_parts(df: DataFrame) -> DataFrame:
    """Adds ``authority`` (as written), ``host`` and ``path`` to a frame with ``url``."""
    df = df.withColumn("authority", F.regexp_extract(rest(F.col("url")), r"^[^/?#]*", 0))
    tail = F.substring(rest(F.col("url")), F.length("authority") + 1, F.lit(2**31 - 1))
    return df.withColumn("host", F.translate("authority", UPPER, LOWER)).withColumn("path", F.regexp_extract(tail, r"^[^?#]*", 0))


def canonical_form():
    """The url without what does not change the page; null for a url without host."""
    query = F.regexp_replace(F.regexp_extract(F.col("url"), r"^[^?#]*\?([^#]*)", 1), r"(^|&)utm_[^&]*", "")
    path = F.regexp_replace("path", r"(\.html|/)$", "")
    host = F.regexp_replace("host", r"^(www|m)\.", "")
    return F.when(F.col("host") != "", F.concat(F.lit("form:"), host, path, F.lit("?"), F.regexp_replace(query, "^&", "")))


def absolute(target):
    """A link of the page as a whole url."""
    scheme = F.substring_index(F.col("url"), "://", 1)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    origin = F.concat(scheme, F.lit("://"), F.col("authority"))
    return (
        F.when(F.instr(target, "://") > 0, target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(origin, folder, target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of redirects and canonical links found in html."""
    with_html = with_parts(pages.select("url", "html").where("url IS NOT NULL AND html IS NOT NULL")).where("host <> ''")
    canonical = F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, HREF, 1))
    redirect = F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, TARGET, 1))
    links = with_html.select("url", "authority", "path", F.explode(F.concat(canonical, redirect)).alias("target")).where("target <> ''")
    return links.select(F.col("url").alias("src"), absolute(F.col("target")).alias("dst")).distinct()


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, ruled) of the urls that a rule fits. Rules are joined on each host suffix, so any number of rules works."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"))
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("ruled"))
    fits = fits.join(rules, "suffix").where(F.col("path").startswith(F.col("start")))
    fits = fits.select("url", F.concat("suffix", "start").alias("rule"), "ruled")
    # Of equally long rules (only possible for one and the same rule stated twice) allow wins.
    best = F.min_by(F.struct("rule", "ruled"), F.struct(-F.length("rule"), F.col("ruled")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.ruled")


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, forms=False) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row; ``links`` (src, dst) adds known redirects, ``forms`` aliases by form."""
    found = page_links(pages)
    if links is not None:
        found = found.union(links.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    found = settle(found, "links")
    known = pages.select("url").union(found.select("src")).union(found.select("dst"))
    urls = with_parts(known.where("url IS NOT NULL").distinct())
    ruled = settle(urls.join(best_rules(urls, rules), "url", "left").select("url", "authority", "host", "path", "rule", "ruled"), "ruled")
    node = lambda c: F.xxhash64(c)
    edges = found.select(node("src").alias("a"), node("dst").alias("b"))
    if forms:
        formed = ruled.select(F.col("url"), canonical_form().alias("form")).where("form IS NOT NULL")
        edges = edges.union(formed.select(node("url").alias("a"), node("form").alias("b")))
    groups = settle(connected_components(edges), "groups")
    placed = ruled.join(groups, node("url") == F.col("node"), "left")
    spread = placed.groupBy("component").agg(F.max(F.col("ruled") == "allow").alias("allows"), F.max(F.col("ruled") == "block").alias("blocks"))
    spread = spread.where("component IS NOT NULL AND blocks AND NOT coalesce(allows, false)").select("component", F.lit("block").alias("spread"))
    verdicts = placed.join(spread, "component", "left").select("url", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"))
    rows = pages.select(F.col("page_id").cast("long"), "url").join(verdicts, "url", "left")
    empty = F.lit("")
    return rows.select("page_id", F.coalesce("host", empty).alias("host"), F.coalesce("path", empty).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rule_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host STRING, path STRING, verdict STRING")


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = f"""
WITH RECURSIVE rules(rhost, rpath, ruled) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
links AS (
  SELECT DISTINCT url AS src, CASE WHEN contains(t, '://') THEN t
         WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
         WHEN starts_with(t, '/') THEN split_part(url, '://', 1) || '://' || auth || t
         ELSE split_part(url, '://', 1) || '://' || auth || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS dst
  FROM (SELECT url, regexp_extract(tail, '^[^/?#]*') AS auth,
               regexp_replace(regexp_extract(substr(tail, length(regexp_extract(tail, '^[^/?#]*')) + 1), '^[^?#]*'), '[^/]*$', '') AS folder,
               unnest(list_concat(list_transform(regexp_extract_all(html, '{_duck(CANONICAL)}'), lambda x: regexp_extract(x, '{_duck(HREF)}', 1)),
                                  list_transform(regexp_extract_all(html, '{_duck(REFRESH)}'), lambda x: regexp_extract(x, '{_duck(TARGET)}', 1)))) AS t
        FROM (SELECT url, html, substr(url, instr(url, '://') + 3) AS tail FROM pages WHERE contains(url, '://') AND html IS NOT NULL))
  WHERE t <> '' AND auth <> ''),
urls AS (
  SELECT url, translate(auth, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(tail, length(auth) + 1), '^[^?#]*') AS path
  FROM (SELECT url, tail, regexp_extract(tail, '^[^/?#]*') AS auth
        FROM (SELECT DISTINCT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
              FROM (SELECT url FROM pages UNION ALL SELECT src FROM links UNION ALL SELECT dst FROM links) WHERE url IS NOT NULL))),
ruled AS (
  SELECT url, host, path, rhost || rpath AS rule, ruled FROM urls
  LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rhost || rpath) DESC, ruled) = 1),
edges AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a),
spread AS (
  SELECT node FROM reach JOIN ruled ON other = url GROUP BY node
  HAVING coalesce(bool_or(ruled = 'block'), false) AND NOT coalesce(bool_or(ruled = 'allow'), false))
SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(ruled, CASE WHEN node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN ruled r ON p.url = r.url LEFT JOIN spread s ON s.node = r.url
"""
