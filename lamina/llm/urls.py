"""URL filter: block decisions spread over redirect and canonical-link aliases, explicit allows first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.components import connected_components
from lamina.llm.staging import col, spare, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host with all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_parts(df: DataFrame, url: str, host: str, path: str, alias: str) -> DataFrame:
    """Add host, path and address of a URL column.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from
    there up to ``?``, ``#`` or the end.  Null or no ``://``: both empty.  Address, the name under which
    aliases meet: host, path and query without scheme and fragment; null where the host is empty.
    """
    rest, query = spare(df, "rest", "query")
    at = F.locate("://", col(url))
    return (
        df.withColumn(rest, F.when(at > 0, F.substring(col(url), at + 3, F.length(col(url)))).otherwise(F.lit("")))
        .withColumns(
            {
                host: F.translate(F.regexp_extract(col(rest), r"^[^/?#]*", 0), UPPER, LOWER),
                path: F.regexp_extract(col(rest), r"^[^/?#]*([^?#]*)", 1),
                query: F.regexp_extract(col(rest), r"^[^?#]*(\?[^#]*)?", 1),
            }
        )
        .withColumn(alias, F.when(col(host) != "", F.concat(col(host), F.when(col(path) == "", F.lit("/")).otherwise(col(path)), col(query))))
        .drop(rest, query)
    )


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, or null.  Of equally long rules an allow wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(df: DataFrame, base: str, host: str, path: str, target: str) -> DataFrame:
    """Make the link target absolute, as seen from the page at ``base``; null where it leads nowhere."""
    link = col(target)
    scheme = F.regexp_extract(col(base), r"^([^:/?#]*)://", 1)
    return (
        df.withColumn(target, F.replace(F.trim(link), F.lit("&amp;"), F.lit("&")))
        .withColumns({"scheme_": scheme, "root_": F.concat(scheme, F.lit("://"), col(host)), "folder_": F.regexp_extract(col(path), r"^(.*/)?[^/]*$", 1)})
        .withColumn(
            target,
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat("scheme_", F.lit(":"), link))
            .when(link.startswith("/"), F.concat("root_", link))
            .when(link.startswith("?"), F.concat("root_", col(path), link))
            .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .otherwise(F.concat("root_", F.when(F.col("folder_") == "", F.lit("/")).otherwise(F.col("folder_")), link)),
        )
        .drop("scheme_", "root_", "folder_")
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between addresses: canonical links and meta refreshes of every page."""
    tags = F.regexp_extract_all(col(html_col), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    linked = pages.where(col(html_col).rlike(r"(?i)canonical|refresh")).select(col(url_col).alias("url"), F.explode(tags).alias("tag"))
    quoted = r"""\s*=\s*["']?\s*"""
    href = F.when(
        F.col("tag").rlike(rf"(?is)^<link\b.*\brel{quoted}(?:[^\"'>]*\s)?canonical\b"),
        F.regexp_extract("tag", rf"""(?is)\bhref{quoted}([^"'\s>]+)""", 1),
    ).when(
        F.col("tag").rlike(rf"(?is)^<meta\b.*\bhttp-equiv{quoted}refresh\b"),
        F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    found = linked.select("url", href.alias("href")).where("href is not null and href <> ''")
    ends = resolved(with_parts(found, "url", "host", "path", "a"), "url", "host", "path", "href")
    return with_parts(ends, "href", "host", "path", "b").select("a", "b")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    redirects: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, alias_blocked), one per row of ``pages``.

    A page that a rule fits has the rule's verdict, so explicit allows precede what its aliases say.
    Otherwise its address is looked up among the connected components of redirects (``redirects``: src,
    dst, for example a crawl log), meta refreshes and canonical links: where some member is blocked by a
    rule and none is allowed by one, all its aliases without a rule are blocked.  All others get
    ``default``.  A null url, or one without ``://``, has empty host and path, no rule and no alias.
    Null html has no links.  Repeated rows get equal rows; an empty table gives none.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        known = with_parts(with_parts(redirects, "src", "host", "path", "a"), "dst", "host", "path", "b")
        edges = edges.unionByName(known.select("a", "b"))
    members = connected_components(stage(edges, "alias-edges"))
    # An address is a URL without its scheme, so rules are judged on it as on any URL.
    named = with_parts(members.withColumn("url", F.concat(F.lit("://"), F.col("node"))), "url", "host", "path", "again")
    judged = named.withColumn("verdict", fitting(rules, F.col("host"), F.col("path"))["verdict"])
    blocked = (
        judged.groupBy("component")
        .agg(F.max(F.col("verdict") == "block").alias("b"), F.max(F.col("verdict") == "allow").alias("a"))
        .where("b and not coalesce(a, false)")
        .select("component")
    )
    aliases = stage(members.join(stage(blocked, "blocked-components"), "component", "left_semi").select("node"), "blocked-addresses")
    own = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"))
    own = with_parts(own.withColumn("url", F.coalesce("url", F.lit(""))), "url", "host", "path", "node")
    met = own.join(aliases.select(F.col("node"), F.lit(True).alias("alias_blocked")), "node", "left")
    rule = fitting(rules, F.col("host"), F.col("path"))
    spread = F.coalesce(F.col("alias_blocked"), F.lit(False))
    return met.withColumn("rule_", rule).select(
        "page_id",
        "host",
        "path",
        F.col("rule_.rule").alias("rule"),
        F.coalesce(F.col("rule_.verdict"), F.when(spread, F.lit("block")).otherwise(F.lit(default))).alias("verdict"),
        spread.alias("alias_blocked"),
    )
