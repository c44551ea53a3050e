"""URL rules with redirect equivalence: pages that lead to one another are judged alike.

Every page address is judged by the longest rule that fits its host and path.  Redirects (``meta http-equiv=refresh``) and
canonical links (``link rel=canonical``) of the pages, or any further table of links, join addresses into groups by distributed
connected components.  An address that no rule fits gets its group's verdict: allow if a member is explicitly allowed, else
block if a member is blocked, else allow.  An address with a rule of its own keeps that rule's verdict whatever its group says.

Everything is a DataFrame expression.  Rules are found by equality, host suffix by host suffix and, where a host has several
rules, path length by path length, so that neither many rules nor a hot host pair all rows with all rules.

Defined results: two urls that differ in fragment or in the case of scheme and host are one address; a null url, or one without
``://``, has empty host and path, no address, no group and the verdict allow; rules of equal length go to allow, then to the
longer host; relative links are resolved against the page's url (dot segments are kept); links in comments and scripts are none;
a page may link to addresses that are no page, and their rules count; repeated rows get the same verdict; an empty table gives
an empty table; very long pages are read whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesync.llm.common import materialise
from lakesync.llm.links import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path): the rules of the registered query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DEFAULT = "allow"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """The url as a request sees it: no fragment, scheme and host in lower case; null without ``://``."""
    parts = r"(?s)^(.*?)://([^/?#]*)([^#]*)"
    piece = lambda k: F.regexp_extract(url, parts, k)
    return F.when(F.instr(url, "://") > 0, F.concat(lowered(piece(1)), F.lit("://"), lowered(piece(2)), piece(3)))


def resolved(links: DataFrame) -> DataFrame:
    """(url, link) pairs as addresses (a, b): ``link`` seen from the page at ``url``; b is null where it names no other page."""
    parts = links.select(
        "url", F.trim(F.regexp_replace("link", r"[\t\n\r]", "")).alias("link"),
        F.regexp_extract("url", r"(?s)^(.*?)://", 1).alias("scheme"), F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1).alias("site"),
        path_of(F.col("url")).alias("path"))
    link, origin = F.col("link"), F.concat("scheme", F.lit("://"), "site")
    folder = F.regexp_extract(F.concat(F.col("path"), F.when(F.col("path") == "", "/").otherwise("")), r"(?s)^(.*/)", 1)
    whole = (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat("scheme", F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, "path", link))
        .otherwise(F.concat(origin, folder, link))
    )
    return parts.select("url", whole.alias("target")).select(address_of(F.col("url")).alias("a"), address_of(F.col("target")).alias("b"))


def _without(html: Column, opening: str, closing: str) -> Column:
    """``html`` without what stands from each ``opening`` to its ``closing`` (or to the end), in one pass."""
    pieces = F.split(html, opening)
    rest = lambda p: F.regexp_extract(p, rf"(?s)^.*?{closing}(.*)$", 1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(rest(p))), " ")


def _attribute(tag: str, name: str) -> Column:
    """The value of an attribute, in double quotes, single quotes or none; empty if absent."""
    value = F.regexp_extract(tag, rf"(?i)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.replace(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): page address and the address that its canonical link or its redirect names.

    The html is looked at only where it has such a tag at all.
    """
    has_tag = F.lower("html").rlike(r"<(link|meta)\s[^<>]*(canonical|refresh)")
    found = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).filter(has_tag)
    plain = _without(_without(F.col("html"), "<!--", "-->"), "(?i)<script", "(?i)</script")
    tags = found.select("url", F.explode(F.regexp_extract_all(plain, F.lit(r"(?i)(<(?:link|meta)\s[^<>]*>)"), F.lit(1))).alias("tag"))
    read = tags.select(
        "url", F.lower(F.substring("tag", 2, 4)).alias("name"), F.split(F.lower(_attribute("tag", "rel")), r"\s+").alias("rel"),
        F.lower(_attribute("tag", "http-equiv")).alias("equiv"), _attribute("tag", "href").alias("href"), _attribute("tag", "content").alias("content"))
    refresh = F.regexp_extract("content", r"(?i)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=)?\s*[\"']?([^\"']*)", 1)
    link = F.when((F.col("name") == "link") & F.array_contains("rel", "canonical"), F.col("href")).when(
        (F.col("name") == "meta") & (F.col("equiv") == "refresh"), refresh)
    return resolved(read.select("url", link.alias("link"))).filter("a <> b")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | tuple[tuple[str, str], ...]) -> DataFrame:
    """(verdict, rule) pairs as the table that ``judge`` takes."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def judge(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, rule, own): the longest rule that fits and its verdict, for the distinct ``address`` values that a rule fits."""
    parts = rules.select(
        "verdict", "rule", lowered(F.substring_index("rule", "/", 1)).alias("rule_host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("rule_path"))
    best_rule = parts.groupBy("rule_host", "rule_path").agg(
        F.max_by(F.struct("verdict", "rule"), F.struct(F.when(F.col("verdict") == "allow", 1).otherwise(0), F.col("rule"))).alias("found"))
    lengths = best_rule.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    hosts = addresses.select("address", host_of(F.col("address")).alias("host"), path_of(F.col("address")).alias("path")).distinct()
    by_host = hosts.select("address", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    by_length = by_host.select("address", "path", "rule_host", F.explode("lengths").alias("k")).filter(F.col("k") <= F.length("path"))
    fitting = by_length.withColumn("rule_path", F.expr("substring(path, 1, k)")).join(best_rule, ["rule_host", "rule_path"])
    order = F.struct(F.length("found.rule"), F.when(F.col("found.verdict") == "allow", 1).otherwise(0), F.length("rule_host"))
    best = fitting.groupBy("address").agg(F.max_by("found", order).alias("found"))
    return best.select("address", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("own"))


def judge_pages(pages: DataFrame, rules: DataFrame, more_links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``more_links`` (a, b) adds pairs of urls known to be the same page."""
    links = page_links(pages)
    if more_links is not None:
        links = links.union(more_links.select(address_of(F.col("a").cast("string")), address_of(F.col("b").cast("string"))).filter("a <> b"))
    groups = materialise(components(links), "url-groups")  # id, component
    url = F.col("url").cast("string")
    placed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    known = placed.select("address").union(groups.select("id")).filter("address IS NOT NULL")
    judged = materialise(judge(known, rules), "url-verdicts")
    members = groups.withColumnRenamed("id", "address").join(judged, "address", "left")
    said = members.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("own") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("own") == "block"), F.lit(False)).alias("blocked"))
    of_group = groups.join(said, "component").select(
        F.col("id").alias("address"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("of_group"))
    return (
        placed.join(judged, "address", "left").join(of_group, "address", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("own", "of_group", F.lit(DEFAULT)).alias("verdict"))
    )


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


SQL12 = r"""
    WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce(url LIKE '%://%', false) AS ok,
                      translate(regexp_extract(coalesce(url, ''), '^(?s)(.*?)://([^/?#]*)([^?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '^(?s)(.*?)://([^/?#]*)([^?#]*)', 3) AS path FROM pages),
    t AS (SELECT url, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--(?s).*?(-->|$)', ' ', 'g'), '(?si)<script.*?(</script|$)', ' ', 'g'),
                                                '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM p WHERE ok),
    h AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link.*\srel\s*=\s*["'']?([^"'']*\s)?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]*)', 1)
                           WHEN regexp_matches(tag, '(?i)^<meta.*http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]*)', 1) END AS href FROM t),
    r AS (SELECT url, CASE WHEN href LIKE '%://%' THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^[^:]*:') || href
                           WHEN href LIKE '/%' THEN regexp_extract(url, '^.*?://[^/?#]*') || href
                           WHEN href LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || href
                           ELSE regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*/|/)?') || href END AS target FROM h WHERE href <> '' AND href NOT LIKE '#%'),
    l AS (SELECT regexp_extract(url, '^[^#]*') AS a, regexp_extract(target, '^[^#]*') AS b FROM r),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    g(a, b) AS (SELECT a, a FROM e UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a),
    v AS (SELECT DISTINCT regexp_extract(url, '^[^#]*') AS a, host, path FROM p WHERE ok
          UNION SELECT DISTINCT a, regexp_extract(a, '^.*?://([^/?#]*)', 1), regexp_extract(a, '^.*?://[^/?#]*([^?#]*)', 1) FROM e),
    f(verdict, rule, rh, rp) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
                                        ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
    j AS (SELECT a, host, path, rule, verdict FROM v LEFT JOIN f ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
          QUALIFY row_number() OVER (PARTITION BY a, host, path ORDER BY length(rule) DESC NULLS LAST) = 1),
    c AS (SELECT g.a, max(CASE WHEN verdict = 'allow' THEN 2 WHEN verdict = 'block' THEN 1 ELSE 0 END) AS said FROM g JOIN j ON j.a = g.b GROUP BY g.a)
    SELECT page_id, p.host, p.path, j.rule, coalesce(j.verdict, CASE WHEN c.said = 1 THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN j ON ok AND j.a = regexp_extract(url, '^[^#]*') AND j.host = p.host AND j.path = p.path
           LEFT JOIN c ON ok AND c.a = regexp_extract(url, '^[^#]*')
"""
