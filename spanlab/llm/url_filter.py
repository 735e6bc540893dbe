"""URL filters with redirect equivalence (operator 10).

A url is judged by the longest rule that fits: rules name a host, which stands for all its
subdomains too, and a path prefix. Urls that are the same page by a redirect (a redirect
table, a refresh in the html) or by a canonical link are aliases: connected components
over these edges carry a block decision to every alias that no rule judges itself. An
explicit allow takes precedence: a url with an allow rule stays allowed, and a component
with an explicitly allowed url passes no block on.

A node of the graph is a url without scheme and fragment, its host in lower case, without
a lone slash at the end. Relative links are resolved against the page's host or folder.

Defined results: a null url or one without ``://`` has an empty host and path, no rule and
no aliases, and is allowed; null html has no links; an empty or broken link is ignored; a
repeated page row is judged each; of two rules with the same host and path allow wins;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import lower_ascii, table, written
from spanlab.llm.graph import connected_components

# The rules of the registered query (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """Graph node of a url, null if it has no host."""
    rest = F.concat(F.regexp_extract(url, URL, 2), F.regexp_extract(url, URL, 3))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(rest, r"\A/\z", "")))


def _attribute(tag: Column, name: str) -> Column:
    pattern = r"""(?is)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""" % name
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    return F.replace(F.trim(value), F.lit("&amp;"), F.lit("&"))


def html_links(html: Column) -> Column:
    """Targets of canonical links and refresh redirects in a page."""
    text = F.coalesce(html, F.lit(""))
    links = F.filter(
        F.regexp_extract_all(text, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?\s*canonical\b"""),
    )
    metas = F.filter(
        F.regexp_extract_all(text, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""),
    )
    refresh = F.transform(
        metas, lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1))
    )
    return F.when(
        text.rlike(r"(?i)canonical|refresh"), F.filter(F.concat(F.transform(links, lambda t: _attribute(t, "href")), refresh), lambda u: u != "")
    ).otherwise(F.array().cast("array<string>"))


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute url, seen from a page."""
    folder = F.regexp_replace(path_of(url), r"[^/]*\z", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(F.lit("http://"), host_of(url), link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(F.lit("http://"), host_of(url), path_of(url), link))
        .otherwise(F.concat(F.lit("http://"), host_of(url), F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, rule_host string, rule_path string")


def judged_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host, path) and the longest fitting rule: ``rule`` and ``action`` (null: none).

    Rules meet the distinct hosts' suffixes in a join; each host then carries its rules.
    """
    hosts = urls.select("host").filter("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = hosts.select(
        "host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host")
    )
    per_host = suffixes.join(rules, "rule_host").groupBy("host").agg(
        F.collect_set(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                (F.col("action") == "allow").alias("allows"),
                F.col("rule_path").alias("path"),
                F.concat("rule_host", "rule_path").alias("rule"),
                "action",
            )
        ).alias("rules")
    )
    joined = urls.join(per_host, "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["path"])))
    return joined.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("action", F.col("best.action")).drop("best", "rules")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url, html).

    ``redirects`` (from_url, to_url) adds known redirects.
    """
    url = F.col("url")
    src = pages.select("page_id", "url", F.col("html"))
    links = src.filter(host_of(url) != "").select("url", F.explode(html_links(F.col("html"))).alias("link"))
    edges = links.select(node_of(url).alias("a"), node_of(resolved(F.col("link"), url)).alias("b"), url.alias("u"), resolved(F.col("link"), url).alias("v"))
    if redirects is not None:
        more = redirects.select(F.col("from_url").alias("u"), F.col("to_url").alias("v"))
        edges = edges.unionByName(more.select(node_of(F.col("u")).alias("a"), node_of(F.col("v")).alias("b"), "u", "v"))
    edges = written(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "url-edges")
    groups = connected_components(edges)

    # every url of a component, also link targets that are no page, has its own rule
    ends = edges.select(F.col("a").alias("node"), F.col("u").alias("url")).unionByName(edges.select(F.col("b").alias("node"), F.col("v").alias("url"))).distinct()
    ends = judged_by_rules(ends.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    spread = ends.join(groups, "node").groupBy("component").agg(
        F.bool_or(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"),
        F.bool_or(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allowed"),
    )
    tainted = spread.filter("blocked AND NOT allowed").select("component")
    tainted = groups.join(tainted, "component").select("node", F.lit(True).alias("alias_blocked"))

    own = src.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    found = judged_by_rules(own, rules).join(tainted, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("alias_blocked"), F.lit("block")), F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule_table(spark))


# The given pages hold no canonical link and no redirect, so the rules alone decide.
ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END r FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM u),
rules(action, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, h || q AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) n
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""
