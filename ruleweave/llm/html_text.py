"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: block elements and line
breaks end a line. Each line has its text, the number of tags met inside it and the section
it lies in. Its text-to-tag ratio is the length of its text over the number of its tags;
text of links, and lines inside menus, footers, adverts and the like, weigh nothing. What is
such by its name, a class, id or role, is named by whole tokens, and adverts, teasers,
comments and notices by any part of one. An article or main element inside something that is
named like a part of the layout is read only if nothing else on the page is. The ratios are smoothed by a Gaussian along the page, and a threshold at a share of their
deviation splits the lines into content and the rest. Content lines vote for their section:
an article or main element if the page has one with content, else the sections that reach
the threshold. All lines of the chosen sections are the text, short ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing in lines, and the threshold in deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 0.5

#: Elements that begin and end lines.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that are never part of the main text.
SKIPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav header footer "
    "aside form button select textarea dialog menu search".split()
)
#: Elements whose text stands for itself, not for the page around it.
SECTIONS = frozenset("article main section div td body html".split())
#: Tokens of a class, id or role that mark what is no main text, and their compounds: a token
#: of such words only, with words for a place or part beside them.
NOISE_WORDS = (
    r"(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|menu|nav|"
    r"navbar|navigation|breadcrumbs?|comments?|replies|disqus|cookies?|consent|notice|notices|gdpr|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|footer|header|masthead|"
    r"toolbar|widget|pagination|pager|skip-link|copyright|contentinfo|complementary|search)"
)
PART_WORDS = (
    r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|block|box|area|bar|section|list|items?|"
    r"container|wrapper|wrap|inner|outer|posts?|articles?|links?|buttons?|form|unit|slot|text|content|[0-9]+)"
)
NOISE = re.compile(
    rf"(?:^|\s)(?:{PART_WORDS}[_-]+)*{NOISE_WORDS}(?:[_-]+(?:{NOISE_WORDS}|{PART_WORDS}))*(?:$|\s)"
)
#: Parts of a token that mark adverts, teasers, comments and notices wherever they stand in it,
#: save behind a word that says what the layout has or lacks.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial adsbygoogle adsense adslot dfp "
    "sponsor sponsored sponsors promo promos promotion promoted taboola outbrain teaser teasers related "
    "recommended recommendation recommendations comment comments discussion replies disqus cookie cookies "
    "consent gdpr newsletter popup".split()
)
GOVERNING = frozenset("with without has have no not is hide show".split())
#: How a line is left out: not at all, by names of the layout around its article, by the names
#: around it, or for good.
KEPT, LIFTED, NAMED, OUT = range(4)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An end tag may be left out where one of these begins.
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}


@lru_cache(maxsize=4096)
def named_level(names: str) -> int:
    """How the class, id and role of an element leave its lines out."""
    for token in names.split():
        for part in re.split("[_-]+", token):
            if part in GOVERNING:
                break
            if part in STRONG:
                return OUT
    return NAMED if NOISE.search(names) else KEPT


class Lines(HTMLParser):
    """Collects (text, tags, link characters, section, how it is left out) of each line of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # element, how it is left out, section
        self.sections: list[tuple[str, int]] = [("page", -1)]  # element, section around it
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0

    @property
    def skipped(self) -> int:
        return self.open[-1][1] if self.open else KEPT

    @property
    def section(self) -> int:
        return self.open[-1][2] if self.open else 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.section, self.skipped))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.end_line()
            self.open.pop()
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower()
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        skip = OUT if tag in SKIPPED or hidden else self.skipped
        if tag in ("article", "main") and skip == NAMED:
            skip = LIFTED
        if tag not in ("html", "body") and named:
            level = named_level(named)
            skip = max(skip, level if level == OUT or tag not in ("article", "main") else KEPT)
        section = self.section
        if tag in SECTIONS:
            self.sections.append((tag, section))
            section = len(self.sections) - 1
        self.open.append((tag, skip, section))
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.links -= sum(name == "a" for name, _, _ in self.open[at:])
                del self.open[at:]
                return
            # A stray end tag of an inline element closes no block.
            if self.open[at][0] in BLOCKS | SKIPPED and tag not in BLOCKS | SKIPPED:
                return

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; the weights at its ends are scaled up."""
    if not len(ratios):
        return ratios
    reach = min(int(3 * sigma + 0.5), len(ratios))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    norm = np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]
    return total / norm


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text of a page, one line per block; empty for null or a page without any."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    least = KEPT

    def judged() -> np.ndarray:
        return np.array([
            0.0 if skipped > least else max(len(text) - linked, 0) / max(tags, 1)
            for text, tags, linked, _, skipped in page.lines
        ])

    ratios = judged()
    if not ratios.any():
        # All articles lie in something named like a part of the layout.
        least = LIFTED
        ratios = judged()
    level = smoothed(ratios, sigma)
    content = (level >= threshold * level.std()) & (ratios > 0)

    def around(section: int) -> Iterator[int]:
        while section >= 0:
            yield section
            section = page.sections[section][1]

    chosen: set[int] = set()
    votes = [
        s for (_, _, _, section, _), wins in zip(page.lines, content, strict=True) if wins
        for s in around(section) if page.sections[s][0] in ("article", "main")
    ]
    if votes:
        chosen.update(votes)
    else:
        chosen.update(line[3] for line, wins in zip(page.lines, content, strict=True) if wins)
    return "\n".join(
        text for text, _, _, section, skipped in page.lines
        if skipped <= least and any(s in chosen for s in (around(section) if votes else (section,)))
    )


def extracted(html: Column) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page) for page in pages.to_pylist()], pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, html_col: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of every page; a column that bears its name is replaced.

    Null and empty pages, and pages without text outside menus and the like, give an empty
    text; a page of notices and adverts alone is such a page. Each row is read by itself and
    whole, so repeated rows, very long pages and nulls elsewhere do not matter; an empty table
    stays empty. Broken markup is read as far as it goes; nothing in it is an error.
    """
    return pages.withColumn(text, extracted(F.col(html_col)))
