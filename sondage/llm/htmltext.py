"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: one for each block of the page, with the length
of its text outside links.  A window of ``WINDOW`` lines slides over them; the
text begins at the first line whose window surges over ``SURGE`` characters
and keeps that level, and ends where the window's sum dives to nothing.  Of
several such stretches the one with most text counts.

Scripts, styles, menus, headers, footers, asides and elements that their role
names as something else are markup too and give no lines.  So are forms and
elements that their class or id names as adverts, notices, comments and the
like, unless they wrap the page: names are judged after a first pass, and an
element with half of the page's text and an article, a main or (but for
comments) a surge stays.  Where most of the stretch's text lies in one
marked region (an ``article``, or ``main``), the points move out to its
borders: short lines at either end are part of it.  Regions elsewhere, such as
teasers marked as articles, are not main text.  If no window surges, an article's lines, or
else all lines, are kept: a short page is not an empty one.

Null html: empty text.  Pages of any length are read whole.  Unclosed and
stray tags are tolerated.  Repeated rows each give a row; an empty table gives
an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from sondage.llm.base import pick

WINDOW, SURGE = 3, 80

#: Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements within a line; all others end one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr img".split())
BOILER = frozenset("head nav header footer aside button select option menu dialog svg canvas audio video object applet".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words in a class or id that name what is not the article.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "header masthead footer comment comments commentlist disqus replies reply respond "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended pagination pager login search skip toolbar legal copyright".split())

#: Of these, names of readers' own text, which surges too.
TALK = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words after these say what an element has beside it or lacks.
_BESIDE = re.compile(r"(?:^|[-_])(?:no|non|not|without|with|has)[-_].*")
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr li main menu nav ol p pre search section summary table ul".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def is_boiler(tag: str, attrs: str) -> bool:
    if tag in BOILER:
        return True
    if not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and not attrs[: m.start()].rstrip().endswith("="):
            return True
        if name == "aria-hidden" and value == "true" and tag not in INLINE:
            return True
        if name == "role" and value in BOILER_ROLES:
            return True
    return False


def other_names(tag: str, attrs: str) -> set[str]:
    """Words of its class or id that name an element as something else than the article; a form's tag does."""
    found = {"form"} if tag == "form" else set()
    if not attrs or tag in ("html", "body", "main"):
        return found
    words = {"comment", "comments", "reply"} if tag == "article" else BOILER_WORDS
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id"):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                found |= words.intersection(_WORDS.findall(_BESIDE.sub("", name)))
    return found


class Line:
    __slots__ = ("text", "weight", "region")

    def __init__(self, text: str, weight: int, region: int):
        self.text, self.weight, self.region = text, weight, region


@dataclass
class Part:
    """A piece of a block's text; named: the innermost named element around it, by number, or -1."""

    text: str
    linked: bool
    named: int

    def weight(self) -> int:
        return 0 if self.linked else len(_SPACE.sub(" ", self.text).strip())


def _hidden(blocks: list[tuple[list[Part], int]], above: list[int], marks: set[int], talk: set[int]) -> set[int]:
    """Named elements that are not the article's wrappers; above: the named element around each, marks: those with an
    article or main, talk: those of readers' text."""
    size, total = [0] * len(above), 0
    for parts, _ in blocks:
        for p in parts:
            total += (w := p.weight())
            if p.named >= 0:
                size[p.named] += w
    for k in range(len(above) - 1, -1, -1):
        if above[k] >= 0:
            size[above[k]] += size[k]
            if k in marks:
                marks.add(above[k])

    def surges(named: int) -> bool:
        inside = {named}
        for k in range(named + 1, len(above)):
            if above[k] in inside:
                inside.add(k)
        weight = [sum(p.weight() for p in parts if p.named in inside) for parts, _ in blocks]
        return any(sum(weight[k : k + WINDOW]) > SURGE for k in range(len(weight)))

    hidden: set[int] = set()
    for k in range(len(above)):
        if above[k] in hidden or 2 * size[k] < total or not (k in marks or k not in talk and surges(k)):
            hidden.add(k)
    return hidden


def lines_of(html: str) -> list[Line]:
    """Blocks of text in page order; region: number of the article around it, 0 outside, negative for ``main``."""
    blocks: list[tuple[list[Part], int]] = []
    parts: list[Part] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, whether it is boilerplate, region and named element before it
    above: list[int] = []  # of each named element, the one around it
    marks: set[int] = set()  # named elements with an article or main
    talk: set[int] = set()  # and those of readers' text
    hidden = region = regions = links = 0
    named = -1
    at, lower = 0, None

    def end() -> None:
        nonlocal parts
        if parts:
            blocks.append((parts, region))
            parts = []

    def pop() -> None:
        nonlocal hidden, region, links, named
        tag, boiler, before, around = stack.pop()
        hidden -= boiler
        links -= tag == "a"
        if tag not in INLINE:
            end()
        region, named = before, around

    m = _TAG.search(html)
    while True:
        stop = m.start() if m else len(html)
        if stop > at and not hidden:
            parts.append(Part(html[at:stop], links > 0, named))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if tag and m[1]:
            if any(x[0] == tag for x in stack):  # a stray end tag closes nothing
                if tag in INLINE and stack[-1][0] != tag:  # inline elements may overlap blocks: only its own entry goes
                    k = max(k for k, x in enumerate(stack) if x[0] == tag)
                    if all(x[0] in INLINE for x in stack[k:]):
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                    else:
                        _, boiler, _, around = stack[k]
                        hidden -= boiler
                        links -= tag == "a"
                        own = stack[k + 1][3]  # inside it
                        if own != around:
                            stack[k + 1 :] = [(*x[:3], around if x[3] == own else x[3]) for x in stack[k + 1 :]]
                            named = around if named == own else named
                        del stack[k]
                else:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag not in INLINE:
                end()
        elif tag in RAW:
            if lower is None:
                lower = html.lower()
                if len(lower) != len(html):  # rare letters change their length
                    lower = re.sub(r"[A-Z]", lambda c: c[0].lower(), html)
            close = lower.find(f"</{tag}", at)
            at = len(html) if close < 0 else close
            m = _TAG.search(html, at)
            if m and m.start() == at:
                at = m.end()
                m = _TAG.search(html, at)
            end()
            continue
        elif tag:
            if tag in ENDS_P:  # a paragraph ends where the next block begins
                k = len(stack) - 1
                while k >= 0 and stack[k][0] in INLINE:
                    k -= 1
                if k >= 0 and stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
            if tag not in INLINE:
                end()
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                boiler = is_boiler(tag, m[3])
                stack.append((tag, boiler, region, named))
                hidden += boiler
                links += tag == "a"
                names = set() if hidden else other_names(tag, m[3])
                if names:
                    above.append(named)
                    named = len(above) - 1
                    if not TALK.isdisjoint(names):
                        talk.add(named)
                main = tag == "main" or "main" in m[3] and re.search(r"role\s*=\s*[\"']?main", m[3])
                if not hidden and tag == "article" and region <= 0:
                    regions += 1
                    region = regions
                elif not hidden and main and region == 0:
                    regions += 1
                    region = -regions
                if not hidden and (main or tag == "article" and not names) and named >= 0:
                    marks.add(named)
        m = _TAG.search(html, at)
    end()
    dropped = _hidden(blocks, above, marks, talk) if above else set()
    lines = []
    for parts, where in blocks:
        shown = [p for p in parts if p.named not in dropped]
        text = _SPACE.sub(" ", unescape("".join(p.text for p in shown))).strip()
        if text:
            lines.append(Line(text, max(0, len(text) - sum(len(p.text.strip()) for p in shown if p.linked)), where))
    return lines


def text_stretch(lines: list[Line]) -> tuple[int, int]:
    """[first, stop) of the main text."""
    sums, total = [], 0
    weight = [x.weight for x in lines]
    for k, w in enumerate(weight):  # sums[k]: of the WINDOW lines from k on
        total += w
        if k >= WINDOW - 1:
            sums.append(total)
            total -= weight[k - WINDOW + 1]
    for k in range(max(0, len(weight) - WINDOW + 1), len(weight)):
        sums.append(sum(weight[k:]))
    best, best_size, k = (0, 0), 0, 0
    while k < len(sums):
        if sums[k] <= SURGE:
            k += 1
            continue
        stop = k
        while stop < len(sums) and sums[stop] > 0:  # the dive
            stop += 1
        if (size := sum(weight[k:stop])) > best_size:
            best, best_size = (k, stop), size
        k = stop + 1
    first, stop = best
    while first < stop and not weight[first]:  # links in the window before the surge
        first += 1
    return first, stop


def main_text(html: str) -> str:
    """The blocks of the main text, one space between them."""
    lines = lines_of(html)
    first, stop = text_stretch(lines)
    if stop > first:
        size: dict[int, int] = {}
        for x in lines[first:stop]:
            size[x.region] = size.get(x.region, 0) + x.weight
        region = max(size, key=size.__getitem__)
        wide = region if region and 2 * size[region] > sum(size.values()) else None
        return " ".join(x.text for k, x in enumerate(lines) if first <= k < stop or x.region == wide)
    marked = {x.region for x in lines if x.region > 0} or {x.region for x in lines if x.region}
    return " ".join(x.text for x in lines if not marked or x.region in marked)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    rows = pick(df, page_id=id_col, url=url_col, _html=html_col)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                texts = [main_text(x or "") for x in s.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [s.column("page_id"), s.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
