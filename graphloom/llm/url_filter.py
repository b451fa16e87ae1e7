"""URL rules, and block decisions that follow redirects and canonical links.

A rule is host and path, like `example.net/en/`: it fits its host and all subdomains if the url's path starts with
the rule's path; of the rules that fit, the longest wins (of equally long ones the smaller string). A url that no
rule fits takes the decision of its redirect-equivalent urls: the connected component over redirect and canonical
edges. An explicit allow goes first: a component with an allowed member and a blocked one leaves its other members
allowed, one with blocked members only blocks them, and without any decision a url is allowed.

Edges come from a page's `<link rel="canonical">` and `<meta http-equiv="refresh">`, or from a table passed. Urls
are nodes without their fragment, with scheme and host in lower case; links are resolved as browsers do, see link_target(). Null urls, or without `://`, have an empty
host and path, fit no rule, are no nodes and are allowed; null or empty html has no edges; repeated pages share their
node and get equal rows. Extra columns don't matter. Empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import connected_components
from graphloom.shipping import ship

#: Verdict and rule.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_REST = r"(?s)^.*?://(.*)$"


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, _REST, 1)
    return F.coalesce(lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    rest = F.regexp_extract(url, _REST, 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The url as a node: null without `://`; else without its fragment, scheme and host in lower case."""
    bare = F.regexp_extract(url, r"(?s)^[^#]*", 0)
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.when(head != "", F.concat(lower_az(head), F.substr(bare, F.length(head) + 1)))


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def link_target(page: str | None, base: str | None, target: str | None) -> str | None:
    """Where a link of a page leads: character references that end in a semicolon are decoded, blanks around and tabs and line
    ends within dropped; then RFC 3986 against the page's <base>, if it has one, else the page, with . and .. resolved. Null for
    nothing, a part of the page, or a target without `://`."""
    clean = lambda s: re.sub(r"[\t\r\n]", "", _REFERENCE.sub(lambda m: html.unescape(m[0]), s)).strip(" \f")
    at = clean(target or "")
    if not page or not at or at.startswith("#"):
        return None
    try:
        found = urljoin(urljoin(page, clean(base or "")), at)
    except ValueError:  # a malformed bracketed address
        return None
    return found if "://" in found else None


def _targets(page: pd.Series, base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([link_target(*x) for x in zip(page, base, target, strict=True)], dtype=object)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'[^']*'|[^\s"'>]+)""", 1)
    single = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*'([^']*)'""", 1)
    plain = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*([^\s"'>]+)""", 1)
    return F.trim(F.when(quoted != "", quoted).when(single != "", single).otherwise(plain))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical links and refreshes join. Comments, scripts and styles hold none; one that
    isn't closed goes to the end of the page. Pages without either word aren't parsed."""
    ship(pages.sparkSession)
    seen = F.regexp_replace(F.col(f"`{html}`"), r"(?is)<!--(?:.*?-->|.*$)|<(script|style)\b(?:.*?</\1\s*>|.*$)", " ")
    tags = F.regexp_extract_all(seen, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*+(?:>|$)"), F.lit(0))
    found = pages.where(F.col(f"`{html}`").rlike("(?i)canonical|refresh")).select(F.col(f"`{url}`").alias("url"), tags.alias("tags"))
    wanted = F.filter("tags", lambda t: t.rlike(r"""(?is)^<link.*\srel\s*=\s*["']?[^"'>]*\bcanonical\b|^<meta.*\shttp-equiv\s*=\s*["']?\s*refresh\b"""))
    base = F.get(F.filter("tags", lambda t: t.rlike(r"(?is)^<base.*\shref\s*=")), F.lit(0))
    each = found.select("url", _attribute(base, "href").alias("base"), F.explode(wanted).alias("tag"))
    refresh = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?is)^[\s0-9.]*[;,]?\s*(?:url\s*=\s*)?['"]?([^'"]*)""", 1)
    to = F.when(F.col("tag").rlike("(?is)^<link"), _attribute(F.col("tag"), "href")).otherwise(refresh)
    ends = each.select("url", F.pandas_udf(_targets, "string")("url", "base", to).alias("to"))
    return ends.select(node(F.col("url")).alias("a"), node(F.col("to")).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def fitting_rule(at_host: Column, at_path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, slash, rest = text.partition("/")
        fits = ((at_host == h) | at_host.endswith(f".{h}")) & at_path.startswith(f"{slash}{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, edges: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, via: 'rule', 'alias' or 'default'."""
    edges = page_edges(pages, url, html) if edges is None else edges
    placed = pages.select(F.col(f"`{page_id}`").alias("page_id"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"), node(F.col(f"`{url}`")).alias("node"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumns({"rule": rule, "own": verdict})
    groups = connected_components(edges)
    members = groups.withColumns({"h": host(F.col("node")), "p": path(F.col("node"))})
    _, by_rule = fitting_rule(F.col("h"), F.col("p"), rules)
    # one row for each component, of partial minima: 'allow' is the smaller string and so goes first
    decided = members.withColumn("own", by_rule).groupBy("root").agg(F.min("own").alias("group_verdict")).where("group_verdict is not null")
    aliases = groups.join(decided, "root").select("node", "group_verdict")
    both = ruled.join(aliases, "node", "left")
    return both.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", "group_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("group_verdict").isNotNull(), "alias").otherwise("default").alias("via"),
    )
