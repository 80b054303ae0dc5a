"""URL rules with redirect equivalence.

Rules (host, path prefix) allow or block a url; the longest that fits wins. Urls that redirect to each other or
name the same canonical url are aliases: the connected components over these links are found in Spark jobs, and
an alias without a rule of its own takes over the decision of its component: allow if any member is explicitly
allowed, else block if any is blocked, else allow.

Defined cases: a url that is null or has no "://" has an empty host and path, fits no rule and, if null, has no
aliases; repeated rows are each judged; null html has no links; every canonical link and every refresh of a page counts,
but none in a comment or script; fragments do not distinguish aliases. Relative targets are resolved
against their page: "//host/x", "/x" and "x" forms. Empty table: empty result. The result's host, path, rule, verdict and
component replace input columns of these names; all others but html pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components

#: (action, host, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*(?:canonical\b|\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b)[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `host` and `path` (strings, never null)."""
    parts = r"\A.*?://([^/?#]*)([^?#]*)"
    has = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    return pages.withColumns(
        {
            "host": F.when(has, F.translate(F.regexp_extract(F.col(url), f"(?s){parts}", 1), UPPER, LOWER)).otherwise(""),
            "path": F.when(has, F.regexp_extract(F.col(url), f"(?s){parts}", 2)).otherwise(""),
        }
    )


def own_rule(rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, action) of the longest rule that fits the columns host and path, or null.

    Longest: by the characters of host and path together; of equally long ones an allow.
    """
    fitting = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    for action, host, path in reversed(fitting):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        chosen = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def _absolute(target: Column, page: Column) -> Column:
    scheme = F.regexp_extract(page, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(page, r"\A([^/]*//[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"\A([^/]*//[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .otherwise(F.concat(folder, target))
    )


def alias_key(url: Column) -> Column:
    """The url without fragment, its host in lower case: what a client asks a server for."""
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_extract(bare, r"(?s)\A([^:/?#]*://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(bare, F.length(head) + 1, F.length(bare)))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): alias keys of pages and of the canonical or refresh targets that their html names."""
    marked = pages.where(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)canonical|http-equiv"))
    found = marked.select(F.col(url).alias("_url"), F.regexp_replace(F.col(html), NO_MARKUP, " ").alias("_html"))
    canonical = F.transform(
        F.regexp_extract_all("_html", F.lit(LINK_TAG), 0), lambda tag: F.concat(*[F.regexp_extract(tag, HREF, i) for i in (1, 2, 3)])
    )
    refresh = F.transform(F.regexp_extract_all("_html", F.lit(META_TAG), 0), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    found = found.select("_url", F.explode(F.concat(canonical, refresh)).alias("_to"))
    found = found.select("_url", F.trim("_to").alias("_to")).where("_to <> ''")
    found = found.select("_url", F.replace(F.col("_to"), F.lit("&amp;"), F.lit("&")).alias("_to"))
    return found.select(alias_key(F.col("_url")).alias("u"), alias_key(_absolute(F.col("_to"), F.col("_url"))).alias("v"))


def judge(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    rules: list[tuple[str, str, str]] = RULES,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """`pages` without `html`, with host, path, rule (string or null), verdict and `component` (null: no alias).

    `redirects`: further links (u, v) between urls, for example of a crawler's log.
    """
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("u")).alias("u"), alias_key(F.col("v")).alias("v")))
    members = components(edges)
    decided = with_host_path(members, "vertex").select("component", own_rule(rules)["action"].alias("action"))
    verdicts = decided.groupBy("component").agg(
        F.when(F.max(F.col("action") == "allow"), "allow").when(F.max(F.col("action") == "block"), "block").alias("_group")
    )
    known = members.join(verdicts, "component").select(F.col("vertex").alias("_key"), "component", "_group")
    judged = with_host_path(pages.drop(html, "component"), url).withColumn("_own", own_rule(rules))
    judged = judged.withColumn("_key", alias_key(F.col(url))).join(known, "_key", "left")
    return judged.withColumns(
        {"rule": F.col("_own.rule"), "verdict": F.coalesce(F.col("_own.action"), F.col("_group"), F.lit("allow"))}
    ).drop("_own", "_key", "_group")
