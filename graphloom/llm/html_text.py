"""Main text of a page by the maximum-scoring subsequence of its words and tags.

A page is a sequence of words and tags. A word scores positive and a tag negative; one linear scan finds the contiguous
region of the highest sum (the first of equal ones). Its blocks become lines: character references decoded, white space
turned into one space, trimmed, empty blocks left out.

The scores are log odds of lying inside the content, learned from labelled pages: those that mark their content with
<article> or <main>. A token's class is its kind (a word, a linked word, or a loose one that stands in no element for text; a
tag by its name) and its place: inside
the page's mark, outside of it, or in a page without one (learned from the labelled pages too, with their marks
ignored). Odds start from a prior of the kind, so that an element that no labelled page has (a list, a table, a quote)
weighs like others of its kind and the scan decides. Words are kept at FLOOR or more, tags at -FLOOR or less.

What is never content is left out of the sequence: scripts, styles, and the elements for menus, footers, sidebars,
dialogs, buttons; forms and headers (but those of an article); elements one of whose class or id names, or whose role, says advert,
reader comments, menu, sidebar, notice and the like as a whole (`sidebar` or `site-footer`, not `has-sidebar`). html,
body, main and article are never left out, nor an element that holds a mark; nor, of forms, headers and names for
places of a layout, one that holds two thirds of a page's words or more.

The weights come from about TRAIN_PAGES pages (twice as many at most) of at most TRAIN_CHARS characters, chosen by a hash
of the page; where none is labelled, the priors hold. Null, empty and wordless pages give an empty text. Parsing takes
linear time and broken markup never fails: a quote counts only at the start of an attribute's value, an unclosed one
ends with its tag, a tag without `>` is text, an unmatched end tag is skipped, an unclosed comment, script or style runs
to the end. Repeated rows get the same text; extra columns are kept, but for those with the name of an output
column. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scan import scan_text, text_sample

TRAIN_PAGES = 400
TRAIN_CHARS = 100_000
FLOOR = 0.05
#: Tokens that a prior counts for.
STRENGTH = 20.0
WORDS = ("word", "loose", "link")
#: Places of a token.
FREE, INSIDE, OUTSIDE = 0, 1, 2
#: Log odds before any labelled page, by kind and place.
PRIOR: dict[str, tuple[float, float, float]] = {
    "word": (1.0, 2.0, 0.05),
    "loose": (0.3, 2.0, 0.05),
    "link": (0.1, 1.0, 0.05),
    "inline": (-0.05, -0.05, -0.05),
    "text": (-0.3, -0.05, -0.3),
    "box": (-0.6, -0.1, -0.6),
    "page": (-2.0, -2.0, -2.0),
    "mark": (-3.0, -0.1, -25.0),
}
#: Element names.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math"}
_NEVER = {"nav", "footer", "aside", "head", "title", "button", "select", "option", "dialog", "menu", "label", "input"}
_OFTEN = {"header", "form"}
_MARKS = {"article", "main"}
_PAGE = {"html", "body"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_TEXT = {"p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "td", "th", "figure", "figcaption", "details", "summary", "address"}
#: An open element of these is closed by the start of the key's.
_CLOSES = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "option": {"option"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}}
_CLOSES |= {x: {"p"} for x in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "table", "figure", "div", "section", "article", "main", "aside", "nav", "footer", "header", "form", "hr", "address")}
#: Parts of class names and ids. What is beside the content wherever it stands; names for places; parts that say nothing.
_BESIDE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "comment", "comments", "commentlist", "disqus", "cookie", "cookies", "consent", "popup", "modal", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "share", "sharing"}
_PLACES = {"banner", "notice", "notices", "sidebar", "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "social", "related", "contentinfo", "complementary", "search"}
_NEUTRAL = {"site", "page", "top", "bottom", "left", "right", "main", "global", "primary", "secondary", "list", "box", "bar", "block", "wrapper", "wrap", "container", "section", "area", "inner", "outer", "widget", "widgets", "buttons", "button", "links", "link", "items", "item", "form", "signup", "posts", "stories", "thread", "reader", "user", "text", "slot", "unit", "google", "message", "overlay", "id"}
_ROLES = {"navigation": 2, "contentinfo": 2, "complementary": 2, "search": 2, "dialog": 2, "alertdialog": 2, "menu": 2, "menubar": 2, "banner": 1, "form": 1}
_NEXT = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _token_says(name: str) -> int:
    """What one class name or id says: 0 nothing, 1 a place beside the content, 2 what never is content."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    if not all(x in _BESIDE or x in _PLACES or x in _NEUTRAL or x.isdigit() for x in parts):
        return 0
    return 2 if any(x in _BESIDE for x in parts) else 1 if any(x in _PLACES for x in parts) else 0


def _attributes_say(attrs: str) -> int:
    says = 0
    for which, a, b, c in _NAMED.findall(attrs):
        for name in (a or b or c).split():
            says = max(says, _ROLES.get(name.lower(), 0) if which.lower() == "role" else _token_says(name))
    return says


_cached_say = lru_cache(10_000)(_attributes_say)


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """(position of the `>` that closes the tag whose attributes start at at, whether there is one). A `>` within a quoted value
    doesn't close it; a value whose closing quote something other than a blank, a slash or `>` follows was never closed."""
    end = page.find(">", at)
    if end < 0:
        return len(page), False
    first = end
    while True:
        quote = -1
        i = at
        while True:  # does an attribute's value that starts before end run over it?
            i = page.find("=", i, end)
            if i < 0:
                break
            i += 1
            while i < end and page[i].isspace():
                i += 1
            if i < end and page[i] in "\"'":
                close = page.find(page[i], i + 1, end)
                if close < 0:
                    quote = i
                    break
                i = close + 1
        if quote < 0:
            return end, True
        close = page.find(page[quote], end)
        after = page[close + 1 : close + 2]
        if close < 0 or after and not after.isspace() and after not in "/>":
            return first, True
        at, end = close + 1, page.find(">", close + 1)
        if end < 0:
            return first, True


@dataclass
class Page:
    """The tokens of a page, and its elements as runs of them."""

    kind: list[str] = field(default_factory=list)  # one of WORDS, or a tag's kind
    name: list[str] = field(default_factory=list)  # a tag's name; empty for text
    text: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    left_out: list[bool] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    has_mark: bool = False


def _kind(name: str) -> str:
    return "inline" if name in _INLINE else "text" if name in _TEXT else "mark" if name in _MARKS else "page" if name in _PAGE else "box"


def _cover(n: int, runs: list[tuple[int, int]]) -> list[bool]:
    change = [0] * (n + 1)
    for a, b in runs:
        change[a] += 1
        change[b] -= 1
    return [x > 0 for x in accumulate(change[:-1])]


def parse(page: str) -> Page:
    out = Page()
    kind, name_of, text_of, words = out.kind, out.name, out.text, out.words
    elements: list[list] = []  # name, says, first token, end
    open_: list[int] = []  # elements, -1 for one that was closed out of turn
    blocks: list[int] = []  # places in open_ of elements that aren't inline
    where: dict[str, list[int]] = defaultdict(list)  # places in open_ by name
    last, size = page.rfind(">"), len(page)

    def text(piece: str) -> None:
        if piece:
            kind.append("link" if where["a"] else "word" if blocks and open_[blocks[-1]] >= 0 and elements[open_[blocks[-1]]][0] in _TEXT else "loose")
            name_of.append("")
            text_of.append(piece)
            words.append(len(piece.split()))

    def pop(to: int) -> None:
        while len(open_) > to:
            e = open_.pop()
            if blocks and blocks[-1] == len(open_):
                blocks.pop()
            if e >= 0:
                elements[e][3] = len(kind)
                where[elements[e][0]].pop()

    def tag(name: str) -> None:
        kind.append(_kind(name))
        name_of.append(name)
        text_of.append("")
        words.append(0)

    at = 0
    while at < size:
        m = _NEXT.search(page, at)
        if not m or m.start() > last:
            break
        text(page[at : m.start()])
        begin = m.start()
        if m.group() == "<!--":
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if page[begin + 1] in "!?":
            at = page.find(">", begin) + 1
            continue
        named = _NAME.match(page, begin)
        name = named.group(1).lower()
        end, closed = _tag_end(page, named.end())
        if not closed:
            text(page[begin:])
            at = size
            break
        attrs = page[named.end() : end]
        at = end + 1
        if page[begin + 1] == "/":
            found = where[name]
            if found:
                place = found[-1]
                if name in _INLINE and blocks and blocks[-1] > place:
                    # an end tag of an inline element doesn't close blocks around it
                    elements[open_[place]][3] = len(kind) + 1
                    open_[place] = -1
                    found.pop()
                    tag(name)
                else:
                    tag(name)
                    pop(place)
            else:
                tag(name)
            continue
        if name in _RAW:
            if not (attrs.endswith("/") and name in ("svg", "math")):
                m = _raw_end(name).search(page, at)
                at = size if not m else m.end()
            tag("br" if name in ("iframe", "svg") else "span")
            continue
        closes = _CLOSES.get(name)
        while closes and blocks and open_[blocks[-1]] >= 0 and elements[open_[blocks[-1]]][0] in closes:
            pop(blocks[-1])
        if name == "a" and where["a"]:
            place = where["a"].pop()
            elements[open_[place]][3] = len(kind)
            open_[place] = -1
        says = 0 if name in _MARKS or name in _PAGE else 2 if name in _NEVER else max(1 if name in _OFTEN else 0, (_cached_say(attrs) if len(attrs) < 1000 else _attributes_say(attrs)) if attrs and "=" in attrs else 0)
        if name == "header" and says == 1 and (where["article"] or where["main"]):
            says = 0
        element = len(elements)
        elements.append([name, says, len(kind), -1])
        tag(name)
        if name in _VOID or attrs.endswith("/") and "=" not in attrs[-2:]:
            elements[element][3] = len(kind)
            continue
        where[name].append(len(open_))
        if name not in _INLINE:
            blocks.append(len(open_))
        open_.append(element)
    text(page[at:])
    pop(0)
    _leave_out(out, [e for e in elements if e[1]], [e for e in elements if e[0] in _MARKS], next((e for e in elements if e[0] == "h1"), None))
    return out


@lru_cache(16)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


def _leave_out(page: Page, said: list[list], marks: list[list], h1: list | None) -> None:
    """Set left_out and marked of the tokens."""
    n = len(page.kind)
    starts = sorted(e[2] for e in marks)

    def holds_mark(e: list) -> bool:
        k = bisect_left(starts, e[2])
        return k < len(starts) and starts[k] < e[3]

    never = [(e[2], e[3]) for e in said if e[1] == 2 and not holds_mark(e)]
    hard = _cover(n, never)
    plain = [0, *accumulate(0 if gone or k == "link" else w for k, w, gone in zip(page.kind, page.words, hard, strict=True))]
    some = [(e[2], e[3]) for e in said if e[1] == 1 and not holds_mark(e) and 3 * (plain[e[3]] - plain[e[2]]) < 2 * max(plain[n], 1)]
    page.left_out = _cover(n, never + some) if some else hard
    marks = [e for e in marks if not page.left_out[e[2]]]
    outer, end = [], 0
    for e in marks:  # in order of their starts
        if e[0] == "article" and e[2] >= end:
            outer.append(e)
            end = e[3]
    main = next((e for e in marks if e[0] == "main"), None)
    if main and outer:
        alone = len(outer) == 1 and not (h1 and main[2] < h1[2] < main[3] and not outer[0][2] < h1[2] < outer[0][3])
        outer = outer if alone else [main]
    elif main:
        outer = [main]
    page.has_mark = bool(outer)
    # the marks' own tags stand outside
    page.marked = _cover(n, [(e[2] + 1, max(e[2] + 1, e[3] - 1 if e[3] and page.name[e[3] - 1] == e[0] else e[3])) for e in outer])


def _keys(page: Page, ignore_mark: bool = False):
    """The class of each token that isn't left out: (kind or tag, place)."""
    for kind, name, marked in zip(page.kind, page.name, page.marked, strict=True):
        place = FREE if ignore_mark or not page.has_mark else INSIDE if marked else OUTSIDE
        yield (name or kind, place)


def learn(pages: list[str]) -> dict[tuple[str, int], float]:
    """Scores by token class, from the pages that have a mark."""
    inside, outside = Counter(), Counter()
    kinds: dict[str, str] = {x: x for x in WORDS}
    for source in pages:
        page = parse(source)
        if not page.has_mark:
            continue
        for ignored in (False, True):
            for key, kind, marked, gone, words in zip(_keys(page, ignored), page.kind, page.marked, page.left_out, page.words, strict=True):
                if not gone:
                    kinds[key[0]] = kind
                    (inside if marked else outside)[key] += words if kind in WORDS else 1
    out = {}
    for key in inside | outside:
        prior = PRIOR[kinds[key[0]]][key[1]]
        share = 1 / (1 + math.exp(-prior))
        odds = math.log(inside[key] + STRENGTH * share) - math.log(outside[key] + STRENGTH * (1 - share))
        out[key] = min(3.0, max(FLOOR, odds)) if kinds[key[0]] in WORDS else min(-FLOOR, odds)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest sum, the first of equal ones; (0, 0) if none is positive."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, found = run, (start, i + 1)
    return found


def _line(block: str) -> str:
    return " ".join((entities.unescape(block) if "&" in block else block).split())


def main_text(source: str | None, weights: dict[tuple[str, int], float]) -> str:
    if not source:
        return ""
    page = parse(source)
    scores = [0.0 if gone else weights.get(key, PRIOR[kind][key[1]]) * (words if kind in WORDS else 1) for key, kind, gone, words in zip(_keys(page), page.kind, page.left_out, page.words, strict=True)]
    start, end = best_region(scores)
    blocks, now = [], []
    for i in range(start, end):
        if page.name[i]:
            if page.kind[i] != "inline":
                blocks.append("".join(now))
                now = []
        elif not page.left_out[i]:
            now.append(page.text[i])
    blocks.append("".join(now))
    lines = (_line(x) for x in blocks if x)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None, train_pages: int = TRAIN_PAGES, weights: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """The kept columns of pages with text and n_chars (code points)."""
    if weights is None:
        column = F.col(f"`{html}`")
        # of very long pages none is learned from, so that what comes to the driver is bounded
        sample = pages.select(column.alias("html")).where(F.length("html").between(1, TRAIN_CHARS) & F.lower("html").rlike(r"<(article|main)\b"))
        weights = learn(sorted(r.html for r in text_sample(sample, "html", train_pages, seed=13).collect()))
    learned = weights

    def fields(column: pa.Array) -> list:
        texts = [main_text(x, learned) for x in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return scan_text(pages, html, "text string, n_chars bigint", fields, keep)
