"""URL filter with redirect equivalence.

Rules judge urls by host and path. Redirects (a given table, or a page's own meta refresh) and canonical links say that
two urls are one resource; connected components over these edges carry decisions to urls that no rule fits: a component
with an allowed url is allowed, else one with a blocked url is blocked, else it is allowed. A url that a rule fits keeps
the rule's verdict.

Defined results: a null url, or one without ://, has empty host and path and is allowed; a null html has no edges; pages with
equal urls are one node and get equal verdicts; links that are empty, or whose scheme isn't http(s), are no edges. The longest
rule wins, of equally long ones allow before block. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnwatch.llm.exprs import LOWER, UPPER, components
from tarnwatch.plans.freeze import freeze

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_parts(rows: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds host, path and name: host, path and query without the fragment, null if there is no host."""
    host, path = url_parts(F.col(url))
    rows = rows.withColumns({f"{prefix}host": host, f"{prefix}path": path,
                             f"{prefix}query": F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)})
    name = F.when(F.col(f"{prefix}host") != "", F.concat(
        f"{prefix}host", F.when(F.col(f"{prefix}path") == "", "/").otherwise(F.col(f"{prefix}path")), f"{prefix}query"))
    return rows.withColumn(f"{prefix}name", name)


def resolved(link: Column, host: Column, path: Column) -> Column:
    """The absolute url of a link on a page; null if it leads to no page."""
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (F.when(link.rlike(r"(?i)^https?://"), link)
            .when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .when((link == "") | link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (host == ""), F.lit(None).cast("string"))
            .when(link.startswith("/"), F.concat(F.lit("http://"), host, link))
            .when(link.startswith("?"), F.concat(F.lit("http://"), host, path, link))
            .when(link.startswith("#"), F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), link)))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The rules are a short list that goes into the plan;
    the first that fits, from the longest down, wins."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def edges(pages: DataFrame) -> DataFrame:
    """(source, target) urls from canonical links and meta refreshes."""
    html = F.coalesce("html", F.lit(""))
    canonical = F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1)
    links = pages.select("url", F.explode(F.array(canonical, refresh)).alias("link")).where("link <> ''")
    links = with_parts(links.withColumn("link", F.replace(F.trim("link"), F.lit("&amp;"), F.lit("&"))), "url")
    return links.select(F.col("url").alias("source"), resolved(F.col("link"), F.col("host"), F.col("path")).alias("target"))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. redirects: (source, target) urls from a crawl log."""
    links = edges(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    links = with_parts(with_parts(freeze(links, "redirects"), "source", "s_"), "target", "t_").select(
        F.col("s_name").alias("source"), F.col("t_name").alias("target"))
    links = freeze(links.where("source is not null and target is not null and source <> target").distinct(), "aliases")
    groups = components(links.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")), "url_links")

    names = links.select(F.col("source").alias("name")).union(links.select("target")).distinct()
    ruled = with_parts(names.select("name", F.concat(F.lit("http://"), "name").alias("url")).withColumnRenamed("name", "node"), "url").select(
        F.xxhash64("node").alias("node"), fitting_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
    verdicts = ruled.join(groups, "node").groupBy("component").agg(
        F.when(F.max((F.col("verdict") == "allow").cast("int")) == 1, "allow")
        .when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise("allow").alias("inherited"))
    inherited = freeze(groups.join(verdicts, "component").select(F.col("node").alias("_node"), "inherited"), "inherited")

    rows = with_parts(pages.select("page_id", "url"), "url").select("page_id", "host", "path", F.xxhash64("name").alias("_node"))
    rows = rows.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(inherited, "_node", "left")
    return rows.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"),
                       F.coalesce("_fit.verdict", "inherited", F.lit("allow")).alias("verdict"))


def _rule_sql(name: str) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""(SELECT struct_pack(r := r.h || r.p, v := r.v) FROM (VALUES {values}) r(v, h, p)
    WHERE ({name}.host = r.h OR ends_with({name}.host, '.' || r.h)) AND starts_with({name}.path, r.p)
    ORDER BY length(r.h || r.p) DESC, r.v LIMIT 1)"""


_PARTS = """translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*'),
  '{u}', '{l}') AS host, regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END,
  '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) AS query""".format(u=UPPER, l=LOWER)

URLS_SQL = rf"""
WITH RECURSIVE p AS (SELECT *, {_PARTS} FROM pages),
found AS (SELECT p.*, replace(trim(unnest([
    regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)])),
    '&amp;', '&') AS link FROM p),
targets AS (SELECT host AS h, path AS pa, query AS q, CASE
    WHEN regexp_matches(link, '(?i)^https?://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN link = '' OR regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') OR host = '' THEN NULL
    WHEN starts_with(link, '/') THEN 'http://' || host || link WHEN starts_with(link, '?') THEN 'http://' || host || path || link
    WHEN starts_with(link, '#') THEN NULL
    ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS url
  FROM found),
t AS (SELECT h, pa, q, {_PARTS} FROM targets WHERE url IS NOT NULL),
e AS (SELECT h || CASE WHEN pa = '' THEN '/' ELSE pa END || q AS a, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS b
  FROM t WHERE h <> '' AND host <> ''),
both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
n AS (SELECT a, b, {_PARTS} FROM (SELECT a, b, 'http://' || b AS url FROM reach)),
inherited AS (SELECT a, CASE WHEN bool_or(fit.v = 'allow') THEN 'allow' WHEN bool_or(fit.v = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM (SELECT a, {_rule_sql("n")} AS fit FROM n) GROUP BY a),
judged AS (SELECT page_id, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS name, {_rule_sql("p")} AS fit FROM p)
SELECT page_id, host, path, fit.r AS rule, coalesce(fit.v, i.verdict, 'allow') AS verdict
FROM judged LEFT JOIN inherited i ON i.a = judged.name"""
