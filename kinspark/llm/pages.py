"""Main text of web pages: parser events, text-to-tag ratios per line, smoothing and threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.text import slices, texts

SIGMA = 1.5
# A line counts as text above this share of the standard deviation of the smoothed ratios.
THRESHOLD_SHARE = 0.5
LINK_SHARE = 0.8
# Clusters of text belong together over a gap of so many lines, or of so much of the main one's text.
GAP_LINES, GAP_SHARE = 12, 0.25
# Marked articles are the page's text if they hold this share of the text clusters.
MARKED_SHARE = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul option optgroup select button textarea".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr body html".split())
# Blocks that may stand within a paragraph; the start of any other ends it.
IN_PARAGRAPH = frozenset("button select textarea option optgroup".split())
DROPPED = frozenset(
    "script style noscript template nav footer aside form button select textarea iframe object svg math canvas audio video head title dialog menu".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion "
    "banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "paywall sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer comment comments "
    "commentlist disqus reply replies respond discussion share sharing sharebar social related recommended recommendations "
    "widget widgets toolbar pagination pager skip copyright legal disclaimer login search hidden".split()
)
# An article or main element is only dropped if it is itself a reader's comment.
COMMENT_NAMES = frozenset("comment reply".split())
# A class such as has-sidebar says something about a page, not what the element is.
MODIFIERS = frozenset("has no with without is not hide show".split())
# Words that may stand beside those names without a meaning of their own; any other word makes a name a subject (social-science).
FILLERS = frozenset(
    "site page main top bottom left right inner outer list lists box boxes item items wrap wrapper container block section area zone unit slot post posts "
    "article articles link links bar bars form button buttons icon icons text message content row col column primary secondary global mobile desktop fixed sticky inline "
    "js css ui id the a an and of by on to in up down open close closed toggle more read latest popular trending google gpt dfp".split()
)
# Within an article these may well be its subject.
SUBJECTS = frozenset("legal disclaimer copyright discussion search login header".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Lines(HTMLParser):
    """Collects lines (text between block tags) with their tags, link text and enclosing element.

    Elements are numbered as they open, 0 being the page; each has its parent and the range of lines within it.
    """

    def __init__(self, by_name: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self._by_name = by_name
        self.hidden_regions = 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.regions: dict[int, str] = {}
        self.parents, self.first, self.last = [0], [0], [0]
        self._open: list[tuple[str, int, bool]] = []  # tag, number, dropped
        self._named: dict[str, int] = {}
        self._dropped = 0
        self._links = 0
        self._parts: list[str] = []
        self._tags = 0
        self._link_text = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.lines.append((text, self._tags, self._link_text, self._open[-1][1] if self._open else 0))
            self._tags = 0
        self._parts, self._link_text = [], 0

    def _is_dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        inside = bool(self._named.get("article") or self._named.get("main"))
        if tag == "header":
            return not inside
        if tag in ("html", "body"):
            return False
        names: set[str] = set()
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id") and self._by_name:
                for own in value.split():
                    parts = {x.lower() for x in _NAME.findall(own) if not x.isdigit()}
                    if parts and parts <= DROPPED_NAMES | FILLERS and not parts & MODIFIERS:
                        names |= parts & DROPPED_NAMES
            elif name == "role" and value.lower() in DROPPED_ROLES or name == "hidden":
                return True
            elif name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSHOWN.search(value):
                return True
        if tag in ("article", "main"):
            return bool(names & COMMENT_NAMES)
        return bool(names - SUBJECTS if inside else names)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._end_line()
            if tag not in IN_PARAGRAPH:
                self._end_paragraph()
        self._tags += 1
        if tag in VOID:
            if tag == "br":
                self._parts.append(" ")
            return
        if tag == "a":
            self._links += 1
        dropped = self._is_dropped(tag, attrs) if attrs or tag in DROPPED or tag == "header" else False
        if dropped or tag in CONTAINERS:
            if not dropped and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                while self._open and self._open[-1][0] == tag:
                    self._close()
            number = len(self.parents)
            self.parents.append(self._open[-1][1] if self._open else 0)
            self.first.append(len(self.lines))
            self.last.append(-1)
            self._open.append((tag, number, dropped))
            self._named[tag] = self._named.get(tag, 0) + 1
            self._dropped += dropped
            if tag in ("article", "main"):
                if self._dropped:
                    self.hidden_regions += not dropped
                else:
                    self.regions[number] = tag

    def _end_paragraph(self) -> None:
        """Close an open (that is, dropped) paragraph, whose end tag may be left out."""
        for at in range(len(self._open) - 1, -1, -1):
            tag = self._open[at][0]
            if tag == "p":
                while len(self._open) > at:
                    self._close()
                return
            if tag in BLOCKS or tag == "object":
                return

    def _close(self) -> None:
        tag, number, dropped = self._open.pop()
        self._named[tag] -= 1
        self._dropped -= dropped
        self.last[number] = len(self.lines)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._tags += 1
        if tag == "a" and self._links:
            self._links -= 1
        if self._named.get(tag):
            while self._open[-1][0] != tag:
                self._close()
            self._close()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not self._dropped:
            self._parts.append(data)
            if self._links:
                self._link_text += len(data)

    def finish(self) -> None:
        self.close()
        self._end_line()
        while self._open:
            self._close()
        self.last[0] = len(self.lines)


def smoothed_ratios(lengths: np.ndarray, tags: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Text characters per tag of every line, smoothed over its neighbours by a Gaussian window."""
    ratios = lengths / np.maximum(tags, 1)
    reach = max(1, int(np.ceil(2 * sigma)))
    window = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    sums = np.convolve(ratios, window)[reach : reach + len(ratios)]
    return sums / np.convolve(np.ones(len(ratios)), window)[reach : reach + len(ratios)]


def text_clusters(content: np.ndarray, lengths: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of text lines that belong to the main cluster, itself included.

    The main cluster is the run of text lines with most text (of equals the first). On either side the next one
    belongs to it as long as the gap is short, in lines or beside the text so far, and not a list of links.
    """
    edges = np.flatnonzero(np.diff(np.concatenate(([0], content.view(np.int8), [0])))).reshape(-1, 2)
    sums, links = (np.concatenate(([0], np.cumsum(x))) for x in (lengths, lengths * linked))
    sizes = sums[edges[:, 1]] - sums[edges[:, 0]]
    main = int(sizes.argmax())
    first, last, total = main, main, sizes[main]

    def near(end: int, begin: int) -> bool:
        gap, link = sums[begin] - sums[end], links[begin] - links[end]
        return (begin - end <= GAP_LINES or gap <= GAP_SHARE * total) and not (link > 0.5 * gap and begin - end > 2)

    while first > 0 and near(edges[first - 1, 1], edges[first, 0]):
        first -= 1
        total += sizes[first]
    while last + 1 < len(edges) and near(edges[last, 1], edges[last + 1, 0]):
        last += 1
        total += sizes[last]
    return [tuple(e) for e in edges[first : last + 1].tolist()]


def _common(parents: list[int], elements: list[int]) -> int:
    """The innermost element around all of these: as elements are numbered as they open, around the least and the greatest."""
    a, b = min(elements), max(elements)
    while a != b:
        a, b = (parents[a], b) if a > b else (a, parents[b])
    return a


def _marked(parser: _Lines, sums: np.ndarray) -> list[int]:
    """Elements that are marked as the page's text and hold enough of it.

    A main element counts for its articles, if they hold most of it. Articles count together with
    their siblings, so one in several parts is whole.
    """
    weight = {r: float(sums[parser.last[r]] - sums[parser.first[r]]) for r in parser.regions}
    total = float(sums[-1])
    articles = [r for r, tag in parser.regions.items() if tag == "article" and weight[r] > 0]
    mains = [r for r, tag in parser.regions.items() if tag == "main" and weight[r] > 0]
    if articles:
        heaviest = max(articles, key=lambda r: (weight[r], -r))
        group = [r for r in articles if parser.parents[r] == parser.parents[heaviest]]
        around = max((weight[m] for m in mains if parser.first[m] <= parser.first[heaviest] and parser.last[heaviest] <= parser.last[m]), default=total)
        if sum(weight[r] for r in group) >= MARKED_SHARE * around:
            return group
    return [max(mains, key=lambda r: (weight[r], -r))] if mains else []


def main_lines(html: str) -> list[str]:
    """The lines of the main text, in page order; none if the page has no text.

    Lines are text by their smoothed ratios. Marked articles with enough of the text are taken
    whole, but for elements that are no text. Otherwise the clusters of text near the main one
    choose: the innermost element around all of them is taken from the first of their
    lines (and a heading, or short lines of the element itself, before it) to the last (likewise), without lists of links. Ties go to the first. If
    nothing is left without the elements whose names say that they are not text, although
    one of them holds an article, those names are not trusted. Time and memory follow the page's length, however deep it is.
    """
    for by_name in (True, False):
        parser = _Lines(by_name)
        parser.feed(html)
        parser.finish()
        lines = parser.lines
        if lines or not parser.hidden_regions:
            break
    if not lines:
        return []
    lengths = np.array([len(t) for t, _, _, _ in lines], float)
    links = np.array([k for _, _, k, _ in lines], float)
    tags = np.array([n for _, n, _, _ in lines], float)
    ratios = smoothed_ratios(lengths, tags)
    linked = links >= LINK_SHARE * lengths
    content = (ratios >= THRESHOLD_SHARE * ratios.std()) & ~linked
    if not content.any():
        content = ~linked if (~linked).any() else np.ones(len(lines), bool)
    kept = np.zeros(len(lines), bool)
    marked = _marked(parser, np.concatenate(([0], np.cumsum(lengths * content))))
    if marked:
        for r in marked:
            kept[parser.first[r] : parser.last[r]] = True
        return [lines[k][0] for k in np.flatnonzero(kept)]
    clusters = text_clusters(content, lengths, linked)
    first, last = clusters[0][0], clusters[-1][1]
    # Smoothing lends short lines the ratio of the text beside them: the ends are lines that are text by themselves, if any is.
    alone = np.flatnonzero((lengths / np.maximum(tags, 1) >= THRESHOLD_SHARE * ratios.std())[first:last])
    if len(alone):
        first, last = first + int(alone[0]), first + int(alone[-1]) + 1
    clusters = [(max(a, first), min(b, last)) for a, b in clusters if a < last and b > first]
    region = _common(parser.parents, [lines[k][3] for a, b in clusters for k in range(a, b)])
    own = np.array([e == region for _, _, _, e in lines]) & ~linked
    if region:
        # Short lines at either end that stand in the region itself, as its paragraphs do.
        while first > parser.first[region] and own[first - 1]:
            first -= 1
        while last < parser.last[region] and own[last]:
            last += 1
    elif first and own[first - 1]:
        # In the page itself only a heading, which is too short to be text.
        first -= 1
    kept[first:last] = True
    run = np.zeros(len(lines), bool)
    run[1:-1] = linked[:-2] & linked[1:-1] & linked[2:]
    if len(lines) >= 3:
        kept &= ~(linked & (np.convolve(run, np.ones(3), "same") > 0))
    return [lines[k][0] for k in np.flatnonzero(kept)]


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Main text of every whole page.

    Returns the key, the columns ``keep``, ``text`` (lines joined by a line feed, empty if
    there is none) and ``n_chars``. Null and empty pages have no text; broken markup is read
    as far as it goes; equal pages have equal texts; an empty table gives an empty one. Other
    columns, whatever their names, are not read.
    """
    keep = [c for c in keep or [] if c not in (key, "text", "n_chars")]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in [key, *keep]) + ", text string, n_chars long"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column(0))
            for a, b in slices(column, 8 << 20):
                found = ["\n".join(main_lines(x)) for x in column.slice(a, b - a).to_pylist()]
                own = [batch.column(k).slice(a, b - a) for k in range(1, batch.num_columns)]
                arrays = [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *arrays], [key, *keep, "text", "n_chars"])

    return pages.select(F.col(html).alias("_html"), key, *keep).mapInArrow(extracted, schema)
