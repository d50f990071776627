"""URL rules that hold for redirect and canonical aliases too (DataFrame operations only).

A rule (host, path, verdict) fits its host and all subdomains when the url's path starts with the rule's; the longest
host plus path wins, and of equally long ones allow. Urls that no rule fits get the decision of their equivalence
class: urls joined by redirects or canonical links are aliases, found by distributed connected components. If an alias
has an allow rule, the class is allowed; else if one has a block rule, it is blocked; else the default holds. A url's own
rule always comes first.

Urls that differ only in the case of scheme and host, or in a fragment, are one. Very long urls and pages are read whole. Null
urls and urls without ``://`` have an empty host and path, fit no rule, and have no aliases. Repeated rows get
the same answer. An empty table gives an empty result. Further columns of the pages are ignored.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table
from quire.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the contract: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def same_url(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case; other texts as they are."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(head == "", url).otherwise(F.concat(F.translate(head, UPPER, LOWER), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    one = [F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules]
    return spark.range(1).select(F.explode(F.array(*one)).alias("r")).select("r.*")


def fitted(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls (url, host, path) with their winning rule and its verdict, null if none fits.

    Each url asks for its host and the host's parents by an equal join, so the rules may be as many as one likes.
    """
    part = F.split("host", r"\.")
    asked = urls.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, F.size(part)), "."))))
    hit = asked.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = hit.groupBy("url").agg(F.max(rank).alias("best"))
    return urls.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"))


def unescaped(text: Column, names: Column) -> Column:
    """Character references decoded, as in the value of an HTML attribute: named (a map) and numeric ones."""
    part = F.regexp_extract_all(text, F.lit(r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z]+[0-9]*(?:;|(?![A-Za-z0-9=;]))|[^&]+|&"), F.lit(0))

    def decoded(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
        code = F.when(F.length(digits) > 7, F.lit(-1)).when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10).try_cast("int")).otherwise(digits.try_cast("int"))
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(~x.startswith("&"), x).when(x.startswith("&#") & (F.length(x) > 2), number).otherwise(F.coalesce(F.try_element_at(names, F.substring(x, 2, 40)), x))

    return F.array_join(F.transform(part, decoded), "")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as it is written; empty if there is none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(F.coalesce(tag, F.lit("")), pattern, i) for i in (1, 2, 3)])


def resolved(base: Column, target: Column) -> Column:
    """The target of a link on a page: absolute as it is, else against the base's scheme, host or directory; null without one."""
    origin, path = F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1), F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest, whole = F.substr(target, F.length(path) + 1), F.concat(origin, path_of(base))
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(path_of(base) == "", "/").otherwise(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)), path))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))
    parts = F.split(full, "/")
    straight = F.concat(F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step), "/"), F.when(full.rlike(r"(?s)/\.\.?$"), "/").otherwise(""))
    relative = F.when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^([^/?#]*:)//", 1), target)).when(path != "", F.concat(origin, straight, rest))
    relative = relative.when(target.startswith("?"), F.concat(whole, target)).when(target.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), target))
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(origin != "", relative)


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) from pages to the targets of their canonical links and meta-refresh redirects.

    Relative targets are resolved against the page's base element or url, character references decoded. What stands in a
    comment is no link.
    """
    html = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?(?:-->|\z)", "")
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<{name}\b[^>]*>"), F.lit(0))
    links = F.filter(tags("link"), lambda t: F.lower(t).rlike(r"rel\s*=\s*[\"']?\s*canonical"))
    metas = F.filter(tags("meta"), lambda t: F.lower(t).rlike(r"http-equiv\s*=\s*[\"']?\s*refresh"))
    kind = lambda name: lambda t: F.struct(F.lit(name).alias("kind"), t.alias("tag"))
    few = pages.where(F.col(html_col).rlike(r"(?i)canonical|refresh")).select(F.col(url_col).alias("a"), F.try_element_at(tags("base"), F.lit(1)).alias("base"), F.explode(F.concat(F.transform(links, kind("link")), F.transform(metas, kind("meta")))).alias("x"))
    # Each step is a generator of one row, over which Spark doesn't merge the expressions (they'd grow manifold).
    step = lambda df, **made: df.select(F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))
    a, base, b = F.col("a"), F.col("base"), F.col("b")
    names = pages.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(html5)), "map<string,string>").alias("names"))
    raw = F.array(attribute(base, "href"), F.when(F.col("x.kind") == "link", attribute(F.col("x.tag"), "href")).otherwise(attribute(F.col("x.tag"), "content")))
    few = step(few, a=a, kind=F.col("x.kind"), raw=raw).crossJoin(F.broadcast(names))
    few = step(few, a=a, kind=F.col("kind"), v=F.transform("raw", lambda t: F.trim(F.regexp_replace(unescaped(t, F.col("names")), r"[\t\r\n]+", ""))))
    # A quoted target of a refresh goes up to its quote, another one to the end of the attribute.
    after = F.regexp_extract(F.col("v")[1], r"(?is)^\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(.*)$", 1)
    few = step(few, a=a, base=F.col("v")[0], b=F.when(F.col("kind") == "link", F.col("v")[1]).otherwise(after), refresh=F.col("kind") != "link")
    quoted = F.concat(F.regexp_extract(b, r"(?s)^\"([^\"]*)", 1), F.regexp_extract(b, r"(?s)^'([^']*)", 1))
    few = step(few, a=a, base=F.when(base != "", resolved(a, base)), b=F.trim(F.when(F.col("refresh") & b.rlike("^[\"']"), quoted).otherwise(b)))
    few = step(few.where("a is not null and b <> ''"), a=a, base=F.coalesce(base, a), b=b)
    return step(few, a=a, b=resolved(base, b)).where("b like '%://%'")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages' columns and host, path, rule, verdict (which replace columns of these names). edges: rows (a, b) of urls that redirect or name a canonical url."""
    kept = pages.select("*", same_url(F.col(url_col)).alias("__url"))
    group = stored(components(edges.select(same_url(F.col("a")).alias("a"), same_url(F.col("b")).alias("b"))), "aliases")
    urls = kept.select(F.col("__url").alias("url")).unionAll(group.select(F.col("node").alias("url"))).where("url is not null").distinct()
    urls = stored(fitted(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules), "urls")
    known = group.join(urls.where("own is not null"), group.node == urls.url)
    decided = known.groupBy("component").agg(F.when(F.max((F.col("own") == "allow").cast("int")) == 1, "allow").otherwise("block").alias("shared"))
    alias = group.join(decided, "component").select(F.col("node").alias("url"), "shared")
    found = urls.join(alias, "url", "left").select(F.col("url").alias("__u"), F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("rule").alias("__rule"), F.coalesce("own", "shared").alias("__verdict"))
    out = kept.join(found, F.col("__url") == F.col("__u"), "left")
    made = ("host", "path", "rule", "verdict")
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c not in made], F.coalesce("__host", F.lit("")).alias("host"), F.coalesce("__path", F.lit("")).alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    edges = html_edges(pages.select("url", "html"))
    return judge(pages.select("page_id", "url"), rules_table(spark), edges).select("page_id", "host", "path", "rule", "verdict")


SQL: dict[str, str] = {
    "op6_url_filter": r"""
WITH RECURSIVE rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p0 AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) ELSE url END AS url, regexp_replace(html, '(?s)<!--.*?(-->|$)', '', 'g') AS html FROM pages),
edges AS (
  SELECT url AS a, regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS t FROM p0) WHERE regexp_matches(lower(t), 'rel\s*=\s*["'']?\s*canonical')
  UNION SELECT url, regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS t FROM p0) WHERE regexp_matches(lower(t), 'http-equiv\s*=\s*["'']?\s*refresh')),
good AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b LIKE '%://%' AND a <> b),
reach(u, w) AS (SELECT a, b FROM good UNION SELECT b, a FROM good UNION SELECT r.u, g.w FROM reach r JOIN (SELECT a AS x, b AS w FROM good UNION SELECT b, a FROM good) g ON r.w = g.x),
urls AS (SELECT url FROM p0 WHERE url IS NOT NULL UNION SELECT u FROM reach),
split AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
own AS (SELECT s.url, host, path, rh || rp AS rule, v FROM split s LEFT JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
        QUALIFY row_number() OVER (PARTITION BY s.url ORDER BY length(rh) + length(rp) DESC NULLS LAST, v) = 1),
alias AS (SELECT r.u AS url, min(o.v) AS v FROM reach r JOIN own o ON o.url = r.w WHERE o.v IS NOT NULL GROUP BY 1)
SELECT page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule, coalesce(o.v, a.v, 'allow') AS verdict
FROM p0 p LEFT JOIN own o ON o.url = p.url LEFT JOIN alias a ON a.url = p.url""",
}
QUERIES = {"op6_url_filter": op6_url_filter}
