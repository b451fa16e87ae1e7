import html
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import html_text, url_filter

PAGES = "page_id long, url string, html string"


def truth(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
    return "\n".join(x for x in blocks if x)


def test_pages_of_the_tables(spark, sf_dir):
    rows = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "html"])
    for r in rows.select("page_id", "text", "n_chars").join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect():
        assert r.text == truth(r.html) and r.n_chars == len(r.text)


def _words(g, n):
    return " ".join("".join(g.choice("abcdeimnorstu") for _ in range(g.randint(2, 8))) for _ in range(n))


def made_page(seed):
    """A page of random structure and the blocks of its content."""
    g = random.Random(seed)
    blocks = []

    def block(a, b):
        blocks.append(_words(g, g.randint(a, b)))
        return blocks[-1]

    def decorated(text):
        ws = text.split()
        k = g.randrange(len(ws))
        ws[k] = g.choice(["<b>{}</b>", "<a href=/x title=don't>{}</a>", "<em class='it'>{}</em>", '<a data-x="a > b" href="#">{}</a>', "<code>{}</code>", "<i>{}"]).format(ws[k])
        return " ".join(ws)

    body = [f"<h1>{block(2, 8)}</h1>"]
    for _ in range(g.randint(4, 12)):
        match g.randrange(9):
            case 0:
                body.append("<ul>" + "".join(f"<li>{decorated(block(1, 12))}</li>" for _ in range(g.randint(2, 6))) + "</ul>")
            case 1:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{block(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(g.randint(2, 4))) + "</table>")
            case 2:
                body.append(f"<h2>{block(1, 6)}</h2><p>{decorated(block(5, 40))}</p>")
            case 3:
                body.append(f"<blockquote><p>{block(5, 20)}</p></blockquote>")
            case 4:
                body.append(f"<pre>{block(3, 12)}</pre>")
            case 5:
                body.append(f"<figure><img src=x alt='no > word'><figcaption>{block(3, 10)}</figcaption></figure>")
            case 6:
                body.append(g.choice(["<div class=ad>{}</div>", "<aside>{}</aside>", '<div class="newsletter-signup"><form>{}</form></div>', "<script>{}</script>", '<div id="related-posts"><a href=/>{}</a></div>']).format(_words(g, g.randint(3, 25))))
            case _:
                body.append(f"<p>{decorated(block(10, 60))}</p>")
    body.append(f"<p>{block(8, 30)}</p>")
    marked = g.random() < 0.6
    inner = "".join(body)
    if marked:
        inner = g.choice(["<article>{}</article>", "<main>{}</main>", "<main><article class='post has-sidebar'>{}</article></main>"]).format(inner)
    else:
        inner = g.choice(["<div id=content>{}</div>", "<section class='post-body'>{}</section>", "<div class='layout with-sidebar'><div class='entry'>{}</div></div>"]).format(inner)
    menu = "".join(f"<li><a href=/{k}>{_words(g, g.randint(1, 2))}</a></li>" for k in range(g.randint(3, 8)))
    top = g.choice([f"<nav><ul>{menu}</ul></nav>", f"<div class='main-menu'><ul>{menu}</ul></div>", f"<header class=site-header><ul>{menu}</ul></header>", f"<div role=navigation>{menu}</div>", f"<div class=x1><ul>{menu}</ul></div>"])
    side = g.choice(["", f"<div class='sidebar'><ul>{menu}</ul><p>{_words(g, 12)}</p></div>", f"<div id=cookie-notice>{_words(g, 10)}</div>"])
    after = g.choice(["", f"<section id=comments><div class=comment><p>{_words(g, g.randint(20, 200))}</p></div></section>"]) + g.choice([f"<footer>{_words(g, 8)}</footer>", f"<div class='site-footer'><p>{_words(g, 8)}</p></div>"])
    classes = g.choice(["", " class='home has-sidebar'", " class='single social-science'"])
    parts = [top, side, inner] if g.random() < 0.5 else [top, inner, side]
    return f"<!DOCTYPE html><html><head><title>{_words(g, 4)}</title><style>p{{}}</style></head><body{classes}>{''.join(parts)}{after}</body></html>", blocks


def quality(weights, seeds):
    """(precision, recall) of words, and the share of pages whose text is right to the byte."""
    right = found = wanted = exact = 0
    for seed in seeds:
        page, blocks = made_page(seed)
        got = html_text.main_text(page, weights)
        a, b = Counter(got.split()), Counter(" ".join(blocks).split())
        right, found, wanted = right + (a & b).total(), found + a.total(), wanted + b.total()
        exact += got == "\n".join(blocks)
    return right / found, right / wanted, exact / len(seeds)


def test_made_pages():
    learned = html_text.learn([made_page(s)[0] for s in range(1000, 1200)])
    of_tables = html_text.learn(["<body><nav><ul><li><a>x</a></li></ul></nav><article><h1>T</h1><p>a b c d</p><p>e f</p></article><footer>z</footer></body>"] * 400)
    for weights in (learned, of_tables, {}):
        precision, recall, exact = quality(weights, range(400))
        assert precision > 0.98 and recall > 0.99 and exact > 0.8, (precision, recall, exact)


def test_lists_tables_and_late_paragraphs_stay():
    page = "<body class='home has-sidebar'><article><h1>Title</h1><p>" + "word " * 25 + "</p><ul><li>one</li><li>two</li></ul><table><tr><td>5</td><td>7</td></tr></table><h2>Second</h2><p>last words</p></article></body>"
    want = "Title\n" + ("word " * 25).strip() + "\none\ntwo\n5\n7\nSecond\nlast words"
    for weights in ({}, html_text.learn(["<body><nav><ul><li><a>x</a></li></ul></nav><article><h1>T</h1><p>a b c d</p></article></body>"] * 400)):
        assert html_text.main_text(page, weights) == want


def test_stray_quotes_swallow_nothing():
    page = "<article><p>a <a href=x title=don't>link</a> b c d</p><p>e isn't f</p></article>"
    assert html_text.main_text(page, {}) == "a link b c d\ne isn't f"
    page = """<article><p>a <a title="x>link</a> <a href="y">more</a> <img alt="is > here"> b</p><p>c</p></article>"""
    assert html_text.main_text(page, {}) == "a link more b\nc"


@pytest.mark.parametrize("piece", ["<b>x", "</i>", "<a title='x>t ", '<a title="x>t ', "<a href=x ", "<div class=ad>", "<!-- x ", "<p>word", "<", "<script>x", "<a b='", "<b><div></b>", "<li>x<p>y", "<td><table>", "&amp", "=\""])
def test_long_pages_take_linear_time(piece):
    page = "<b>" * 1000 + piece * (1_000_000 // len(piece)) + "</b>" * 1000
    began = time.perf_counter()
    assert isinstance(html_text.main_text(page, {}), str)
    assert time.perf_counter() - began < 15


def test_unwanted_parts_and_broken_markup():
    learned = html_text.learn(["<body><nav><a>x</a></nav><article><h1>T</h1><p>a b c d</p><p>e f</p></article><footer>z</footer></body>"] * 5)
    page = """<html><head><title>no</title><style>p{}</style></head><body><header class="site-header"><a>Home</a></header><div id="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>One&nbsp;two <b>thr</b>ee   four five six seven eight</p><div class="ad">Buy now</div><script>var a="</p>";</script><aside>Also see</aside><p>Nine ten eleven twelve &#233;&lt;</p>
    <form><input value=x>Sign up</form></article><section class="comments"><p>First!</p></section><footer>c 2020</footer></body>"""
    assert html_text.main_text(page, learned) == "Title & more\nOne two three four five six seven eight\nNine ten eleven twelve é<"
    for broken in ("<", "<p", "<p title='x>abc", "<!-- never closed", "a < b > c", "</p></p></div>", "<script>x", "&#x110000;&bogus;", "<a href=x>" * 2000):
        assert isinstance(html_text.main_text(broken, learned), str)


@given(st.lists(st.floats(-5, 5, allow_nan=False), max_size=30))
def test_best_region_is_the_largest_sum(scores):
    start, end = html_text.best_region(scores)
    best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
    assert sum(scores[start:end]) == pytest.approx(max(best, 0))


def test_extract_awkward(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<article><p>x y</p></article>"), (4, "w", "plain words only")], PAGES)
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extract(rows, keep=["page_id", "url"]).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "x y", 3), (4, "plain words only", 16)}
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def page(*tags):
    return "<html><head>" + "".join(tags) + "</head></html>"


CANONICAL = '<link rel="canonical" href="{}">'
REFRESH = '<meta http-equiv="refresh" content="0; url={}">'


def test_decisions_follow_aliases(spark):
    rows = [
        (1, "http://a.com/x", page(CANONICAL.format("https://spam.net/y"))), (2, "https://spam.net/y", None), (3, "http://b.com/1", page(REFRESH.format("/2"))), (4, "http://b.com/2", page(CANONICAL.format("http://a.com/x#part"))),
        (5, "http://c.org/1", page(CANONICAL.format("http://c.org/fr/1"), CANONICAL.format("http://q.net/"))), (6, "http://c.org/fr/1", ""), (7, "http://q.net/", ""), (8, "http://free.com/", ""), (9, None, None), (10, "no scheme", "x"), (1, "http://a.com/x", ""),
        (11, "HTTP://WWW.Example.NET/en/a?b#c", ""), (12, "http://example.net/de/", ""), (13, "http://notexample.com/de/x", ""), (14, "http://sub.example.com/de/x", ""), (15, "http://x.net", ""),
    ]
    got = {(r.page_id, r.verdict, r.rule) for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {
        (1, "block", None), (2, "block", "net/"), (3, "block", None), (4, "block", None), (5, "allow", None), (6, "allow", "org/fr/"), (7, "block", "net/"), (8, "allow", None), (9, "allow", None), (10, "allow", None),
        (11, "allow", "example.net/en/"), (12, "block", "net/"), (13, "allow", None), (14, "block", "example.com/de/"), (15, "allow", None),
    }
    parts = {r.page_id: (r.host, r.path) for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert parts[11] == ("www.example.net", "/en/a") and parts[9] == parts[10] == ("", "") and parts[15] == ("x.net", "")
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_components(spark):
    import random

    from graphloom.llm.cluster import connected_components

    g = random.Random(3)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    # a node with most of the edges
    star = [(7, i) for i in range(10, 2500)] + [(i, i + 5000) for i in range(10, 500)]
    found = connected_components(spark.createDataFrame(star, "a long, b long"))
    assert found.count() == 1 + 2490 + 490 and found.where("root <> 7").count() == 0
