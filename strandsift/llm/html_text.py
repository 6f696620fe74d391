"""Main-text extraction from HTML by line-block distribution.

Markup is stripped to lines, one for each block of text, with the length of the text that is no link. The lines'
lengths are summed over sliding windows; where the sums rise over the limit is a surge, where they fall below it for
good a dive, and the text between is the article, with the lines that share the container of its ends. Containers whose
role is known from the markup (navigation, footers, asides, forms, scripts, adverts, notices, comments) are never lines;
a form is one of them unless it holds most of the page. A line of what the page marks as its article counts as a little
longer; the windows decide."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import encoded

#: Elements by what becomes of their content.
RAW = frozenset("script style noscript template textarea title iframe object select xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside head menu dialog button figure canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded semantics annotation svg g path rect circle ellipse line polyline polygon use defs text tspan""".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())
#: Parts of class, id and role names that name what is no article; whole names that do; and parts that
#: turn a name into its opposite or into a mere frame of it.
UNWANTED = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation navbox menu menubar breadcrumb breadcrumbs
header masthead footer sidebar aside comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended recommendations toolbar pagination pager contentinfo complementary search""".split())
#: Of these, those that a single paragraph or heading can be.
UNWANTED_PARAGRAPHS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription comment comments hidden".split())
UNWANTED_NAMES = frozenset("hidden widget rail skip".split())
#: Of a name inside an article, what may stand beside such a part; a section on related work is text.
GENERIC = frozenset("posts post articles article links link list box block section container bar area content form widget inner outer top bottom left right main site page items item buttons button group".split())
#: Inside an article these may be its subject.
SUBJECTS = frozenset("header search social share sharing signup notice notices".split())
NEGATING = frozenset("has have with no not without is wrapper layout".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|!--|[!?/])")
_NAME = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?=$|[\s=/])(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _names(attributes: str) -> list[str]:
    return [n for m in _NAME.finditer(attributes) for n in next(filter(None, m.groups()), "").lower().split()]


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the article, by its own name or by those it was given. An article's own header
    holds its title; a paragraph goes only if all its names say so."""
    if name in DROPPED:
        return not (in_article and name in ("header", "figure"))
    if not attributes or name in ("body", "html", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    told = []
    for one in _names(attributes):
        parts = set(_PART.findall(one))
        if name in CLOSED_BY_BLOCK:
            told.append(bool(parts & UNWANTED_PARAGRAPHS) and not parts & NEGATING)
            continue
        bad = parts & UNWANTED
        if in_article and (parts - UNWANTED - GENERIC or parts <= SUBJECTS):
            bad = set()
        told.append(one in UNWANTED_NAMES or bool(bad) and not parts & NEGATING)
    return bool(told) and (all(told) if name in CLOSED_BY_BLOCK else any(told))


class Line(NamedTuple):
    """A block: its text, how many characters of it are outside links, whether it is inside a marked article, the number
    of its container, whether it is the page's title, whether it is inside a form."""

    text: str
    plain: int
    marked: bool
    container: int
    title: bool
    formed: bool


def lines(page: str) -> list[Line]:
    """The blocks in page order. Those of forms are left out, unless they hold more text than all others."""
    out: list[Line] = []
    buffer: list[str] = []
    plain = 0
    # open elements that are not inline, whether they are unwanted, and the container whose text theirs is
    stack: list[tuple[str, bool, int]] = []
    unwanted = articles = links = containers = forms = 0
    ends: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal plain
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                out.append(Line(text, plain, articles > 0, stack[-1][2] if stack else 0, bool(stack) and stack[-1][0] == "h1", forms > 0))
            buffer.clear()
        plain = 0

    def close(depth: int):
        nonlocal unwanted, articles, forms
        while len(stack) > depth:
            name, bad, _ = stack.pop()
            unwanted -= bad
            articles -= name in ("article", "main")
            forms -= name == "form"

    def say(raw: str):
        nonlocal plain
        if raw and not unwanted:
            text = html.unescape(raw)
            buffer.append(text)
            if not links:
                plain += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        tag = _TAG.match(page, lt)
        if tag is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/" and page[lt + 2 : lt + 3].isalpha()):
                end = page.find(">", lt)  # a quote that is never closed
                if end < 0:
                    break  # the page ends inside a tag
                at = end + 1
                continue
            say("<")
            at = lt + 1
            continue
        if tag[2] is None:
            end = page.find("-->", lt + 4) if tag[0] == "<!--" else page.find(">", lt)
            if end < 0:
                break
            at = end + (3 if tag[0] == "<!--" else 1)
            continue
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        at = tag.end()
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                if end is None:
                    break
                shut = page.find(">", end.end())
                at = n if shut < 0 else shut + 1
            if name in ("textarea", "title"):
                flush()
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                say(" ")
            elif not closing and name not in VOID and _unwanted(name, attributes, articles > 0):
                if name not in ends:
                    ends[name] = _inline_ends(page, name)
                at = ends[name].get(lt, at)
            continue
        flush()
        links = 0
        if name in VOID:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
            continue
        if stack and stack[-1][0] in CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        if name in ("li", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        if name in ("article", "main"):
            for depth, (outer, _, _) in enumerate(stack):
                if outer == "nav":  # never closed
                    close(depth)
                    break
        bad = _unwanted(name, attributes, articles > 0)
        containers += 1
        stack.append((name, bad, stack[-1][2] if stack and name in CLOSED_BY_BLOCK else 0 if name in CLOSED_BY_BLOCK else containers))
        unwanted += bad
        articles += name in ("article", "main")
        forms += name == "form"
    flush()
    inside = sum(x.plain for x in out if x.formed)
    if inside <= sum(x.plain for x in out) - inside:
        return [x for x in out if not x.formed]
    return out


def _inline_ends(page: str, name: str) -> dict[int, int]:
    """Where each inline element of that name that is closed begins and ends, nesting counted."""
    opened: list[int] = []
    out = {}
    for m in re.compile(rf"<(/?){name}\b[^<>]*>", re.I).finditer(page):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def main_text(page: str, width: int = 3, limit: int = 120, mark: int = 30) -> str:
    """The article's blocks, joined by an empty line. ``width``: lines in a window; ``limit``: characters outside links
    that a window needs for a surge, or a quarter of the page's, if that is less. ``mark``: characters by which a line
    counts as longer if the page marks it as its article's, half a line as it were; a mark alone makes no surge and
    takes nothing from other lines. Between surge and dive, lines stay that are not almost all links."""
    found = lines(page)
    n = len(found)
    limit = min(limit, max(1, sum(x.plain for x in found) // 4))
    weights = [x.plain + mark * x.marked if x.plain else 0 for x in found]
    kept = [x.marked or x.plain * 5 >= len(x.text) for x in found]
    sums = [0] * (n + 1)
    for i, x in enumerate(weights):
        sums[i + 1] = sums[i] + x
    surge = next((i for i in range(n) if weights[i] and sums[min(n, i + width)] - sums[i] >= limit), n)  # a line and those after it
    dive = next((i for i in range(n - 1, -1, -1) if weights[i] and sums[i + 1] - sums[max(0, i + 1 - width)] >= limit), -1)  # and those before
    if dive < surge:
        return ""
    while surge and kept[surge - 1] and (found[surge - 1].container == found[surge].container or found[surge - 1].title):
        surge -= 1
    while dive + 1 < n and kept[dive + 1] and found[dive + 1].container == found[dive].container:
        dive += 1
    return "\n\n".join(found[i].text for i in range(surge, dive + 1) if kept[i])


def extract(pages: DataFrame, html_column: str = "html", output: str = "main_text") -> DataFrame:
    """``pages`` with a string column ``output``: the main text of each whole page, '' if there is none.

    Null and empty pages have none; bytes that the cut-off end of a page leaves are read as far as they go; rows that
    repeat are extracted each; a column that already has the output's name is replaced."""
    columns = [c for c in pages.columns if c != output]
    schema = pages.select(columns).schema.add(output, "string")
    at = columns.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x.decode("utf-8", "replace")) for x in encoded(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*columns, output])

    return pages.select(columns).mapInArrow(run, schema)
