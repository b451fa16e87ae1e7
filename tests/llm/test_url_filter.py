"""Url decisions against a plain union-find over links that were written by hand."""

import random

import pytest

from graphloom.llm import url_filter

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("page", "base", "target", "want"),
    [
        ("http://a.com/x/y?q=1", None, "z", "http://a.com/x/z"), ("http://a.com/x/y", None, "../../w/./v", "http://a.com/w/v"), ("http://a.com", None, "b", "http://a.com/b"),
        ("http://a.com/x", None, "?a=1&amp;b=2", "http://a.com/x?a=1&b=2"), ("http://a.com/x", None, "/p?a=1&copy=2", "http://a.com/p?a=1&copy=2"), ("http://a.com/x", None, "/y&#47;&#x62;", "http://a.com/y/b"),
        ("http://a.com/x", "http://b.org/d/", "e", "http://b.org/d/e"), ("http://a.com/x/", "../s/", "e", "http://a.com/s/e"), ("https://a.com/x", None, "//c.net/", "https://c.net/"), ("http://a.com/x", None, " \n/y\t ", "http://a.com/y"),
        ("http://a.com/x", None, "#top", None), ("http://a.com/x", None, "", None), ("http://a.com/x", None, "mailto:a@b.c", None), ("http://a.com/x", None, "javascript:void(0)", None), (None, None, "/y", None), ("http://a.com/", None, "http://[bad", None), ("http://a.com/", None, None, None),
    ],
)
def test_link_targets(page, base, target, want):
    assert url_filter.link_target(page, base, target) == want


def test_tags_that_count(spark):
    u = "http://a.com/d/p"
    cases = [
        ('<LINK HREF=/one REL=Canonical>', "/one"), ("<link href='/two?x=1&amp;y=2' rel='alternate canonical'>", "/two?x=1&y=2"), ('<base href="http://a.com/b/"><link rel="canonical" href="../three">', "/three"),
        ('<meta http-equiv=refresh content="5; URL=\'/four\'">', "/four"), ('<meta content="0;/five" http-equiv="Refresh">', "/five"),
        ('<!-- <link rel="canonical" href="/no"> -->', None), ('<script>"<link rel=canonical href=/no>"</script>', None), ('<!-- <link rel="canonical" href="/no">', None), ('<meta http-equiv="refresh" content="30">', None),
        ('<link rel="stylesheet" href="/canonical.css">', None), ('<meta name="refresh" content="0;url=/no">', None), ('<a rel="canonical" href="/no">x</a>', None), ('<link rel="canonical" href="/d/p#self">', None), ("<link rel=canonical href=/last", "/last"),
    ]
    for markup, to in cases:
        got = [tuple(r) for r in url_filter.page_edges(spark.createDataFrame([(1, u, markup)], PAGES)).collect()]
        assert got == ([] if to is None else [(u, f"http://a.com{to}")]), markup


def test_redirects_against_brute_force(spark):
    """Long chains, a target that many share, pages that repeat, and every kind of link, over sites with and without rules."""
    g = random.Random(11)
    urls = [f"http://{site}/{folder}{i}" for i in range(60) for site, folder in [(g.choice(["a.com", "b.com", "spam.net", "x.org", "example.net"]), g.choice(["", "en/", "fr/", "q?a=1&b="]))]]
    urls += [f"http://chain.com/{i}" for i in range(70)] + [f"http://hub.com/{i}" for i in range(400)] + ["http://hub.org/fr/"]
    links = [(g.choice(urls[:60]), g.choice(urls[:60])) for _ in range(25)]
    links += [(f"http://chain.com/{i}", f"http://chain.com/{i + 1}") for i in range(69)] + [("http://chain.com/69", "http://end.net/")]
    links += [(f"http://hub.com/{i}", "http://hub.org/fr/") for i in range(400)] + [("http://hub.com/3", "http://bad.net/")]
    forms = ('<link rel="canonical" href="{}">', "<link href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">')
    pages = [(i, u, "") for i, u in enumerate(urls)] + [(1000 + i, a, g.choice(forms).format(b.replace("&", "&amp;"))) for i, (a, b) in enumerate(links)]
    pages.append((5000, None, forms[0].format("http://a.com/")))

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def own(u):
        host, _, rest = u.split("://")[1].partition("/")
        path, fits = "/" + rest.partition("?")[0], []
        for verdict, rule in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), verdict))
        return max(fits)[1] if fits else None

    for a, b in links:
        parent[find(a)] = find(b)
    verdicts = {}
    for u in list(parent):
        if own(u):
            verdicts.setdefault(find(u), set()).add(own(u))

    def want(u):
        if u is None:
            return "allow"
        group = verdicts.get(find(u), set()) if u in parent else set()
        return own(u) or ("allow" if "allow" in group else "block" if group else "allow")

    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "'x' AS rule", "'y' AS verdict", "1 AS node", "2 AS root", "3 AS own", "4 AS h")
    got = sorted((r.page_id, r.verdict) for r in url_filter.judge(df).collect())
    assert got == sorted((i, want(u)) for i, u, _ in pages)
    assert {v for _, v in got} == {"allow", "block"} and sum(1 for i, u, _ in pages if u and own(u) is None and want(u) == "block") > 60


def test_long_pages(spark):
    for piece in ("<!-- ", "<link ", "<script>", "<meta x='canonical' ", "<base href"):
        assert url_filter.page_edges(spark.createDataFrame([(1, "http://a.com/", "refresh " + piece * 200_000)], PAGES)).count() == 0
