"""URL verdicts: rules by host and path, handed on to aliases over redirects and canonical links.

DataFrame operations only. Pages are aliases when a page's HTML names another URL as canonical
(``<link rel=canonical href=..>``) or sends the reader there (``<meta http-equiv=refresh ..>``), in any
number of steps, or when their URLs differ only in scheme, a leading ``www.``, fragment, a final slash
or ``utm_`` parameters.

The longest rule that fits a URL decides. Where none fits, a page is blocked if one of its
aliases is blocked by a rule and none is allowed by a rule; otherwise it is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule, and is
nobody's alias; null HTML has no links; repeated rows each get their own equal row; links that
cannot be resolved are ignored. In the tags, ``&amp;`` and its numeric forms are read as ``&``; other character references
stay as they are written. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setwright.llm.components import connected_components
from setwright.session import staged

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that may name another address, and where in them the address stands.
_TAG = r"(?is)<(?:link|meta)\s[^>]*>"
_CANONICAL = r"(?is)\srel\s*=\s*[\"']?canonical[\"'\s/>]"
_REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s/>]"
_AMPERSAND = r"&(?:amp|AMP|#0*38|#[xX]0*26);"
_HREF = r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)url\s*=\s*[\"']?([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def alias_key(url: Column) -> Column:
    """What URLs of one page have in common; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&"
    )
    key = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host != "", key)


def resolved(link: Column, url: Column) -> Column:
    """A link's absolute address on the page at ``url``; null where it has none."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(url, _URL, 1))
    folder = F.regexp_replace(path_of(url), r"(?s)[^/]*$", "")
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("#") | link.startswith("?"), F.lit(None))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pairs of alias keys ``a, b`` that a page's HTML says are one page."""
    u, h = pages[url], pages[html]
    tags = F.regexp_extract_all(h, F.lit(_TAG), F.lit(0))
    telling = F.filter(tags, lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    # Before the address is taken out, as one in a refresh ends at a semicolon.
    plain = F.transform(telling, lambda t: F.regexp_replace(t, _AMPERSAND, "&"))
    to = F.transform(plain, lambda t: F.when(t.rlike(_CANONICAL), F.regexp_extract(t, _HREF, 1)).otherwise(F.regexp_extract(t, _TARGET, 1)))
    # Most pages have no such tag; the plain substring test keeps them from the patterns.
    low = F.lower(h)
    some = pages.filter(low.contains("canonical") | low.contains("http-equiv"))
    found = some.select(u.alias("u"), F.explode(to).alias("link")).filter("link != ''")
    return (
        found.select(alias_key(F.col("u")).alias("a"), alias_key(resolved(F.col("link"), F.col("u"))).alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .distinct()
    )


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(n, action, rule)``, or null.

    ``rules`` is a setting: (action, host and path) pairs. Of equally long rules an allowing one wins.
    """
    parts = []
    for action, rule in rules:
        at = rule.index("/") if "/" in rule else len(rule)
        site, prefix = rule[:at].lower(), rule[at:]
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(prefix)
        mark = F.struct(F.lit(len(rule)).alias("n"), F.lit(action == "allow").alias("allow"), F.lit(rule).alias("rule"))
        parts.append(F.when(fits, mark))
    parts.append(F.lit(None).cast("struct<n:int,allow:boolean,rule:string>"))
    return F.array_max(F.array(*parts))


def url_verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: ``key, host, path, rule, verdict``."""
    alias = connected_components(links(pages, url, html))
    parsed = pages.select(
        pages[key].alias("_key"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), alias_key(pages[url]).alias("_alias")
    )
    ruled = parsed.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = ruled.join(alias, F.col("_alias") == alias["node"], "left").select(
        "_key", "host", "path", F.coalesce("component", "_alias").alias("_page"), F.col("_rule.rule").alias("rule"), F.col("_rule.allow").alias("_allow")
    )
    # Pages of which one address is blocked by a rule and none is allowed; combined before the shuffle.
    blocked = staged(
        judged.filter(F.col("_allow").isNotNull() & F.col("_page").isNotNull())
        .groupBy(F.col("_page").alias("_blocked"))
        .agg(F.bool_or("_allow").alias("_any_allow"))
        .filter("NOT _any_allow")
        .select("_blocked"),
        "blocked",
    )
    verdict = (
        F.when(F.col("_allow"), "allow").when(F.col("_blocked").isNotNull() | F.col("rule").isNotNull(), "block").otherwise("allow")
    )
    return judged.join(blocked, F.col("_page") == F.col("_blocked"), "left").select(
        F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict")
    )
