"""Url filters by redirect equivalence: block decisions reach the aliases of a page.

Two urls are aliases when a page of one names the other as its canonical address or sends the
reader on to it. Rules decide first; a url that no rule fits takes the decision of its
component in the graph of these links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import components

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH_URL = r"(?is)\burl\s*=\s*['\"]?([^'\">]*)"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the path, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a query or fragment; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """The name of a url in the alias graph: host, path and query, without scheme and fragment.

    Null for urls without ``://``. An empty path counts as ``/``.
    """
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    place = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), place, query))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules given as (action, host with path) to columns rule_host, rule_path, rule, action."""
    rows = [(*_cut(rule), rule, action) for action, rule in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, action string")


def _cut(rule: str) -> tuple[str, str]:
    name, slash, rest = rule.partition("/")
    return name, slash + rest


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each distinct url: (url, rule, action).

    Every url is looked up under each of its host's suffixes and each length of path that some
    rule has, an equality join that never meets a url with all rules of a host. Of rules of the
    same length an allowing one goes first.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    heads = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    keys = (
        urls.select("url", "host", "path")
        .select("url", "path", F.explode(suffixes).alias("rule_host"))
        .select("url", "rule_host", F.explode(F.array_compact(heads)).alias("rule_path"))
    )
    best = F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("a"), "rule", "action")
    return (
        keys.join(rules, ["rule_host", "rule_path"])
        .groupBy("url")
        .agg(F.max(best).alias("best"))
        .select("url", "best.rule", "best.action")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Canonical links and immediate redirects written in the pages: (source, target) addresses.

    Relative targets are read against the page's own url; null html has none.
    """
    tags = (
        pages.where(F.col("html").rlike(_CANONICAL) | F.col("html").rlike(_REFRESH))
        .select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
        .where(F.col("tag").rlike(_CANONICAL) | F.col("tag").rlike(_REFRESH))
    )
    href = F.concat(*[F.regexp_extract("tag", _HREF, i) for i in (1, 2, 3)])
    written = F.when(F.col("tag").rlike(_CANONICAL), href).otherwise(F.regexp_extract("tag", _REFRESH_URL, 1))
    target = F.trim(F.replace(written, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host(F.col("url")))
    folder = F.regexp_extract(path(F.col("url")), r"(?s)^(.*/)", 1)
    absolute = (
        F.when(F.contains("target", F.lit("://")), F.col("target"))
        .when(F.startswith("target", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("target")))
        .when(F.startswith("target", F.lit("/")), F.concat(root, F.col("target")))
        .when(F.col("target") != "", F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), "target"))
    )
    return tags.withColumn("target", target).select(
        address(F.col("url")).alias("source"), address(absolute).alias("target")
    )


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Pages with host, path, rule and verdict (allow or block).

    ``redirects`` (source_url, target_url) are links known from elsewhere, such as a crawl log.
    A url takes the action of its longest rule. Without a rule it is blocked when its component
    holds a blocked url and no expressly allowed one, else allowed. A null url, or one without
    ``://``, has empty host and path and no aliases; null html has no links; repeated rows are
    judged alike; an empty table gives an empty one. Columns of the pages other than page_id
    and url are not read beyond html, so that clashing names do no harm.
    """
    rows = pages.select("page_id", "url", "html")
    urls = rows.select("url").distinct().withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    links = page_links(rows)
    if redirects is not None:
        links = links.unionByName(
            redirects.select(
                address(F.col("source_url")).alias("source"), address(F.col("target_url")).alias("target")
            )
        )
    placed = components(links, "source", "target").select(F.col("node").alias("address"), "root")
    # rules also judge the ends of links that were never fetched themselves
    linked = placed.select(F.concat(F.lit("any://"), "address").alias("url"))
    linked = linked.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    ruled = match_rules(urls, rules)
    named = match_rules(urls.unionByName(linked), rules).select(address(F.col("url")).alias("address"), "action")
    shared = (
        named.join(placed, "address")
        .groupBy("root")
        .agg(F.max(F.col("action") == "block").alias("b"), F.max(F.col("action") == "allow").alias("a"))
        .where("b and not a")
        .select("root")
    )
    blocked = placed.join(shared, "root").select("address", F.lit("block").alias("passed_on"))
    decided = (
        urls.join(ruled, "url", "left")
        .withColumn("address", address(F.col("url")))
        .join(blocked, "address", "left")
        .select(
            F.col("url").alias("_url"), "rule", F.coalesce("action", "passed_on", F.lit("allow")).alias("verdict")
        )
    )
    return rows.join(decided, F.col("url").eqNullSafe(F.col("_url")), "left").select(
        "page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", "verdict"
    )
