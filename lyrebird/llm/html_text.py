"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of the page; what stands in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments makes blank lines. Text lengths are summed over windows
of ``WINDOW`` lines: a block of text surges where such a sum rises to the threshold and dives where it falls to
nothing. Text between surge and dive is kept. Where the page marks its article, each marked container whose own lines
surge is kept from its first to its last line of text, however short, if these containers hold at least half of all
the text that surges: articles before main elements before names. Else the marks are doubted, and the text between surge
and dive stays. A name doesn't make an element boilerplate if it speaks of the layout (with-sidebar), or if the element holds
the page's main element, or the only article, or most of the text where nothing else surges. Where nothing surges, the surest container with the most text is kept, or else the run with the most.

Blocks are the lines between block-level tags and line breaks; character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined by one line feed; nothing else is dropped.

Defined results: null or empty html, or a page without text, gives an empty string; a page cut off in a tag, comment or
script ends there; repeated rows each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyrebird.llm.common import cap_batches

WINDOW = 3
#: Characters of non-link text in a window at which a block of text begins.
SURGE = 90

# HTML element names and words of class names, ids and roles.
RAW = "script style title textarea".split()
UNSEEN = "noscript template iframe svg math object canvas audio video".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul br".split())
SKIP_TAGS = frozenset("nav footer button select option menu dialog legend datalist".split())
#: Skipped like an element of a misleading name: not where they hold the article.
WRAPPERS = frozenset("aside fieldset form".split())
#: Characters from which a form, or the like, that holds most of the page's text is no form.
LONG = 4 * SURGE
#: Further words that, beside the words above, make no heading of an article's section.
PART_WORDS = frozenset("area article articles bar block box container content form items link links list main page post posts section stories title top wrap wrapper".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related recommended recommendations reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: A class name with one of these says how the page is laid out, not what the element holds.
LAYOUT_WORDS = frozenset("with without no not has hide hides show shows".split())
#: Words for lists of what isn't the article, though their entries may be marked as articles.
OTHERS = frozenset("comment comments disqus feedback recommended recommendations related replies reply respond responses".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
NEVER_SKIPPED = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?:/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_CLOSE = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in UNSEEN}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z0-9]+")

#: A section's first heading, right behind its start.
_FIRST_HEADING = re.compile(r"\s*+(?:<(?:div|span|a|header)\b[^<>]*+>\s*+){0,3}<(h[1-6])\b[^<>]*+>(.{0,400}?)</\1", re.DOTALL | re.IGNORECASE)
_MARKUP = re.compile(r"<[^<>]*+>")
#: A tag without its end, for pages where quotes don't pair.
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)" rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)" r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)" r"|<[!?/][^>]*+(?:>|\Z)", re.DOTALL | re.IGNORECASE)

PLAIN, SKIP, HEAD_ONLY, HEADING = range(4)


class _Tags:
    """The page's tags one after the other: (start, end, tag, whether it ends an element, attributes, whether it is whole).

    A tag ends at the next '>' outside quotes, or without one at the next '>'. Once a tag has no end outside quotes, one pass from the page's end
    tells for every place where a tag there would end, so that no tag is read to the end of the page twice.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self._places: list[int] | None = None

    def _look_back(self) -> None:
        """For each quote and '>': the '>' that ends a tag which is outside quotes there, or -1."""
        self._places = [m.start() for m in re.finditer("[>\"']", self.page)]
        self._ends = [-1] * (len(self._places) + 1)
        later = {}
        for k in range(len(self._places) - 1, -1, -1):
            sign = self.page[self._places[k]]
            if sign == ">":
                self._ends[k] = self._places[k]
            else:
                self._ends[k] = self._ends[later[sign] + 1] if sign in later else -1
                later[sign] = k

    def next(self, at: int) -> tuple[int, int, str, bool, str, bool] | None:
        page = self.page
        if self._places is None:
            m = _TOKEN.search(page, at)
            if not m:
                return None
            if m["tag2"]:
                self._look_back()
            else:
                return m.start(), m.end(), (m["tag"] or "").lower(), bool(m["end"]), m["attrs"] or "", page.endswith(">", m.start(), m.end())
        m = _OPEN.search(page, at)
        if not m:
            return None
        if not m["tag"]:
            return m.start(), m.end(), "", False, "", page.endswith(">", m.start(), m.end())
        end = self._ends[bisect.bisect_left(self._places, m.end())]
        if end < 0:
            end = page.find(">", m.end())
        stop = end if end >= 0 else len(page)
        return m.start(), min(stop + 1, len(page)), m["tag"].lower(), bool(m["end"]), page[m.end() : stop], end >= 0


def _of_heading(name: str, heading: re.Match | None) -> bool:
    """Whether an id is made of the words of the section's heading, and so marks nothing; comments and the like are marked all the same."""
    if not heading:
        return False
    words = [w.lower() for w in _CAMEL.split(name) if w]
    if words != [w.lower() for w in _CAMEL.split(html.unescape(_MARKUP.sub("", heading[2]))) if w]:
        return False
    return any(w not in SKIP_WORDS | PART_WORDS for w in words) or not set(words) & OTHERS


def _marks(tag: str, attrs: str, heading: Callable[[], re.Match | None] = lambda: None) -> tuple[bool, set[str], int]:
    """Whether the element is boilerplate, the words of its names that say so, and how surely it holds the article: 3 article, 2 main, 1 by its name, 0 not.

    An id on a heading marks nothing, nor does one that repeats the words of the section's ``heading``.
    """
    named: set[str] = {tag} & WRAPPERS
    skip, main = tag in SKIP_TAGS or tag == "header", 3 if tag == "article" else 2 if tag == "main" else 0
    if attrs.strip(" /"):
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "role":
                skip |= value.lower() in SKIP_ROLES
                main = max(main, 2 if value.lower() == "main" else 3 if value.lower() == "article" else 0)
            elif name in ("class", "id"):
                words = {w.lower() for w in _CAMEL.split(value)}
                if words & SKIP_WORDS and not (name == "id" and (tag in HEADINGS or _of_heading(value, heading()))):
                    names = [{w.lower() for w in _CAMEL.split(name)} for name in value.split()]
                    named.update(*(n & SKIP_WORDS for n in names if not n & LAYOUT_WORDS))
                if tag in ("div", "section", "td") and words & MAIN_WORDS:
                    main = max(main, 1)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                skip = True
    return (False, set(), main) if tag in NEVER_SKIPPED else (skip, named, main)


@dataclass
class _Skipped:
    """An element that is skipped for its names alone, or as a form or the like: its text's length, how surely it holds articles, whether it lists others' texts."""

    others: bool
    wraps: bool = False
    size: int = 0
    holds: frozenset[int] = frozenset()


@dataclass
class _Container:
    """How surely an element holds the article, and the container around it, or -1."""

    kind: int
    around: int


class _Lines:
    """The page's lines: raw text, length outside links, and the innermost container, or -1. Blank lines have no text."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.plain: list[int] = []
        self.inside: list[int] = []
        self._parts: list[str] = []
        self._linked = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        if linked:
            self._linked += len(text)

    def end(self, inside: int) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.text.append(text)
                self.plain.append(max(0, len(text) - self._linked))
                self.inside.append(inside)
            self._parts, self._linked = [], 0

    def blank(self) -> None:
        if self.text and self.text[-1]:
            for _ in range(WINDOW):
                self.text.append("")
                self.plain.append(0)
                self.inside.append(-1)


class _Page:
    """One pass over a page's tags, with the open elements. Each step takes the same time however deep they nest.

    ``lines``, ``containers``, and ``skipped``: by its place what was skipped for its names alone. Elements at the places ``spared`` aren't
    skipped for their names.
    """

    def __init__(self, page: str, spared: frozenset[int] = frozenset()) -> None:
        self.lines, self.containers, self.skipped = _Lines(), [], {}
        self._spared = spared
        self._stack: list[tuple[str, int, int, int]] = []  # tag, mode, container or -1, place if skipped for its names alone or else -1
        self._open: Counter[str] = Counter()
        self._blocks: list[int] = []  # where block elements stand in the stack
        self._heads: list[int] = []  # modes HEADING and HEAD_ONLY of open elements
        self._named: list[int] = []  # places of open elements that are skipped for their names alone
        self._skips = self._hard = self._links = 0
        self._inside = -1
        self._read(page)
        while self._stack:
            self._pop()

    def _kept(self) -> bool:
        return not self._skips and (not self._heads or self._heads[-1] == HEADING)

    def _push(self, tag: str, mode: int, container: int, place: int) -> None:
        if tag in BLOCKS:
            self._blocks.append(len(self._stack))
        self._stack.append((tag, mode, container, place))
        self._open[tag] += 1
        self._links += tag == "a"
        if mode in (HEADING, HEAD_ONLY):
            self._heads.append(mode)
        if mode == SKIP:
            self._skips += 1
            self._hard += place < 0
            if place >= 0:
                self._named.append(place)
        if container >= 0:
            self._inside = container

    def _pop(self) -> int:
        tag, mode, container, place = self._stack.pop()
        if tag in BLOCKS:
            self._blocks.pop()
        self._open[tag] -= 1
        self._links -= tag == "a"
        if mode in (HEADING, HEAD_ONLY):
            self._heads.pop()
        if mode == SKIP:
            self._skips -= 1
            self._hard -= place < 0
            if place >= 0:
                self._named.pop()
                if self._named:  # what it holds, the skipped element around it holds too
                    own, outer = self.skipped[place], self.skipped[self._named[-1]]
                    outer.size += own.size
                    outer.holds |= own.holds
        if container >= 0:
            self._inside = self.containers[container].around
        return mode

    def _text(self, text: str) -> None:
        if self._kept():
            self.lines.add(text, self._links > 0)
        elif self._named and not self._hard:
            self.skipped[self._named[-1]].size += len(text.strip())

    def _read(self, page: str) -> None:
        lines, at = self.lines, 0
        closes = dict.fromkeys(UNSEEN, 0)  # end of each element's next end tag, or -1 if none is left: looked for once
        tags = _Tags(page)
        while found := tags.next(at):
            start, stop, tag, ends, attrs, whole = found  # not whole: cut off inside a tag
            if start > at:
                self._text(page[at:start])
            at = stop
            if not tag or not whole:
                continue
            if tag in closes and not ends:
                if attrs.endswith("/"):
                    continue
                if 0 <= closes[tag] < at:
                    close = _CLOSE[tag].search(page, at)
                    closes[tag] = close.end() if close else -1
                if closes[tag] >= 0:
                    at = closes[tag]
                    continue
            block = tag in BLOCKS
            if block:
                lines.end(self._inside)
            if ends:
                while self._open[tag]:
                    was = self._stack[-1][0]
                    if self._pop() == SKIP:
                        lines.blank()
                    if was == tag:
                        break
                continue
            if tag in VOID or attrs.endswith("/") and not block:
                continue
            if block and self._blocks:  # a block ends an open paragraph; an item ends the one before
                last = self._stack[self._blocks[-1]][0]
                if last == "p" or last == tag == "li":
                    for _ in range(len(self._stack) - self._blocks[-1]):
                        self._pop()
            self._start(tag, attrs, start, page, stop)
        if at < len(page) and self._kept():
            lines.add(page[at:], self._links > 0)
        lines.end(self._inside)

    def _start(self, tag: str, attrs: str, at: int, page: str, stop: int) -> None:
        within = tag if self._inside >= 0 and tag in ("section", "div") else ""
        skip, named, main = _marks(tag, attrs, lambda: within and _FIRST_HEADING.match(page, stop))
        if at in self._spared:
            named = set()
        mode = PLAIN
        if skip or named:
            mode = HEAD_ONLY if tag == "header" and self._inside >= 0 else SKIP
        elif tag in HEADINGS:
            mode = HEADING
        container = -1
        if main and mode == PLAIN and not self._skips:
            self.containers.append(_Container(main, self._inside))
            container = len(self.containers) - 1
        elif main > 1 and mode == PLAIN and self._named and not self._hard:
            self.skipped[self._named[-1]].holds |= {main}
        place = at if mode == SKIP and not skip else -1
        if place >= 0:
            self.skipped[at] = _Skipped(bool(named & OTHERS), wraps=tag in WRAPPERS)
        self._push(tag, mode, container, place)
        if mode == SKIP:
            self.lines.blank()


def _outermost(containers: list[_Container], least: int) -> list[int]:
    """For each container the outermost one around it, or itself, that holds the article as surely as ``least`` or more; -1 without one."""
    out: list[int] = []
    for i, c in enumerate(containers):
        above = out[c.around] if c.around >= 0 else -1
        out.append(above if above >= 0 else i if c.kind >= least else -1)
    return out


def _spared(page: _Page) -> frozenset[int]:
    """Places of the elements whose names mislead: a main element is in them, or else, where what is left has no article,
    an article, or where it has no marked container and no surge, most of the page's text."""
    lines = page.lines
    left = sum(map(len, lines.text))
    surest: list[int] = []
    for c in page.containers:
        surest.append(max(c.kind, surest[c.around] if c.around >= 0 else 0))
    seen = max((surest[c] for c in lines.inside if c >= 0), default=0)
    surges = bool(text_blocks(lines.plain, SURGE))
    # a share of the page without what lists others' texts
    own = left + max((e.size for e in page.skipped.values() if not e.others), default=0)

    def misled(e: _Skipped) -> bool:
        if 2 in e.holds:
            return True
        if seen > 1 or not e.size or e.others and left:
            return False
        most = 2 * e.size > own
        if 3 in e.holds:
            return most or not surges
        if e.wraps:
            return most and not seen and e.size >= LONG
        return most and not seen and not surges

    return frozenset(place for place, e in page.skipped.items() if misled(e))


def text_blocks(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, end line) of each run between a surge to ``surge`` and the dive to nothing of the windows' sums."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    out, start, high = [], None, False
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start, high = i, False
        if start is not None:
            high |= s >= surge
            if not s:
                if high:
                    out.append((start, i))
                start = None
    return out


def _groups(page: _Page, least: int) -> list[range]:
    """The lines of each outermost container that holds the article as surely as ``least`` or more."""
    outermost, out = _outermost(page.containers, least), {}
    for i, inside in enumerate(page.lines.inside):
        if inside >= 0 and (c := outermost[inside]) >= 0:
            out.setdefault(c, [i, i])[1] = i
    return [range(a, b + 1) for a, b in out.values()]


def _chosen(page: _Page) -> set[int]:
    """Numbers of the lines to keep."""
    lines = page.lines
    size = list(map(len, lines.text))
    runs = [range(a, b) for a, b in text_blocks(lines.plain, SURGE)]
    surging = sum(size[i] for r in runs for i in r)
    for least in sorted({c.kind for c in page.containers}, reverse=True):
        groups = _groups(page, least)
        if runs:
            groups = [g for g in groups if text_blocks(lines.plain[g.start : g.stop], SURGE)]
            if 2 * sum(size[i] for g in groups for i in g) < surging:  # most of what surges is elsewhere
                continue
        elif any(size[i] for g in groups for i in g):  # nothing surges: the container with the most text
            groups = [max(groups, key=lambda g: (sum(size[i] for i in g), -g.start))]
        if groups:
            return {i for g in groups for i in g}
    if not runs:  # nothing surges and no container has text: the run with the most text
        runs = sorted((range(a, b) for a, b in text_blocks(lines.plain, 1)), key=lambda r: (-sum(lines.plain[i] for i in r), r.start))[:1]
    return {i for r in runs for i in r}


def main_text(html_text: str | None) -> str:
    """The page's main text; see the module's text for what counts."""
    if not html_text:
        return ""
    page = _Page(html_text)
    if page.skipped and (spared := _spared(page)):
        page = _Page(html_text, spared)
    keep = _chosen(page)
    return "\n".join(t for i, t in enumerate(page.lines.text) if t and i in keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py()) for page in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    cap_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
