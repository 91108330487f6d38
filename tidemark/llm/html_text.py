"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import pick

#: Smoothing width in lines, and the share of the ratios' standard deviation that a content line reaches.
SIGMA, SHARE = 1.0, 0.5
#: Characters a tag from which a line is as good as any: longer ones do not lift the threshold.
LONG = 200
#: Share of the selected text that an article holds to be the region whole; of a line's text in links to be a menu.
LEAST, LINKED = 0.3, 0.6
#: A box inside an article that a mark may take away although the mark could also be a word of its subject.
SHORT = 140
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of which no text is ever shown as an article's, wherever they stand.
CLOSED = frozenset(
    "script style noscript template head title button select option textarea input label iframe object svg math canvas audio video map".split()
)
#: Elements that stand around an article; they may also be wrapped around one.
OUTSIDE = frozenset("nav footer aside dialog menu search".split())
#: Words in a class, id or role that mark what stands around an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended widget newsletter "
    "subscribe subscription signup login popup modal overlay paywall pagination pager toolbar complementary contentinfo search "
    "hidden".split()
)
#: Those of them that an article's own section may be named after; words that say what kind of box it is, and those
#: of these that no section of an article is called.
SUBJECTS = frozenset(
    "notice notices alert banner discussion reply replies related recommended search share sharing social promotion subscription "
    "sponsor consent header overlay respond complementary notification".split()
)
BOX = frozenset(
    "area bar bars block body bottom box boxes button buttons card cards col column container content count entry form icon icons inner item "
    "items left link links list lists main module more news outer pane panel post posts article articles right row section side site "
    "stories story text thread title top unit view wrap wrapper zone".split()
)
CHROME = frozenset(
    "articles bar bars box boxes button buttons card cards count form icon icons items link links list lists module news panel post posts "
    "stories thread zone".split()
)
ARTICLE = frozenset(("article", "main"))
#: Elements that hold a line rather than lines.
LINE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption summary legend figcaption pre address".split())
#: A tag that the end of the page cuts off.
_CUT = re.compile(r"<[A-Za-z/!][^<>]*\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none")
#: End tags that a tag implies.
_ENDS = {"li": ("li", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p"), "dt": ("dt", "dd", "p"),
         "dd": ("dt", "dd", "p"), "option": ("option",)}


@dataclass
class Line:
    """A block of the page: its text, the tags met on the way, its text in links, and the innermost element around it."""

    text: str
    tags: int
    linked: int
    element: int
    heading: bool = False
    around: bool = False


@dataclass
class Page:
    """Lines, and elements by number: 0 is the page. A parent's number is smaller than its children's."""

    lines: list[Line] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    mark: list[str] = field(default_factory=lambda: [""])
    articles: list[int] = field(default_factory=list)

    def summed(self, sizes: dict[int, float]) -> list[float]:
        """For each element what it and all below it have."""
        out = [0.0] * len(self.parent)
        for element, size in sizes.items():
            out[element] = size
        for element in range(len(out) - 1, 0, -1):
            out[self.parent[element]] += out[element]
        return out

    def handed_down(self, given: dict[int, int]) -> list[int]:
        """For each element the value of the nearest one above it, itself included, that has one, else 0."""
        out = [given.get(0, 0)] * len(self.parent)
        for element in range(1, len(out)):
            out[element] = given.get(element, out[self.parent[element]])
        return out

    def by_line(self, size: list[float]) -> dict[int, float]:
        out: dict[int, float] = {}
        for line, n in zip(self.lines, size, strict=True):
            out[line.element] = out.get(line.element, 0) + n
        return out


def words_in(value: str) -> list[str]:
    return [w.lower() for w in _PARTS.findall(value)]


def marked(tag: str, attrs: dict[str, str], in_article: bool) -> str:
    """How an element says that it is no part of an article: closed, tag, words or maybe (see settle); else "".

    A header within an article belongs to it; the elements of the whole page say nothing.
    """
    if tag in ("html", "body"):
        return ""
    if tag in CLOSED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return "closed"
    if tag == "form":
        return "words"
    if tag in OUTSIDE or tag == "header" and not in_article:
        return "tag"
    if tag == "main":
        return ""
    how = ""
    for value in (attrs.get(k, "") for k in ("class", "id", "role")):
        for name in value.split():
            words = [name.lower()] if tag == "article" else words_in(name)
            told = AROUND.intersection(words) - ({"header"} if in_article else set())
            if not told:
                continue
            plain = all(w in AROUND or w in BOX for w in words)
            if not in_article or plain and (told - SUBJECTS or not CHROME.isdisjoint(words)):
                return "words"
            if plain or told - SUBJECTS:
                how = "maybe"
    return how


def settle(page: Page) -> None:
    """Decides which lines are surroundings, once the whole page is known.

    A mark does not count on what an article stands in, be it a tag or a word, nor a word or a form on what holds
    most of the page's text that is not in links: these are wrappers. Articles with little text beside the largest
    one, such as teasers and comments, do not say so of their boxes. Inside such an article a name that could be
    that of a section counts only for a box that is short or mostly links.
    """
    unlinked = page.by_line([max(0, len(x.text) - x.linked) for x in page.lines])
    held = page.summed(unlinked)
    all_text, linked = (page.summed(page.by_line(x)) for x in ([len(x.text) for x in page.lines], [x.linked for x in page.lines]))
    own = {n: held[n] for n in page.articles if not page.mark[n] and held[n] > 0}
    large = [n for n, size in own.items() if size >= LEAST * max(own.values())]
    wrapper = [x > 0 for x in page.summed(dict.fromkeys((page.parent[n] for n in large if n), 1.0))]
    given: dict[int, int] = {}
    for element, how in enumerate(page.mark):
        if how == "tag":
            counts = not wrapper[element]
        elif how:
            counts = not wrapper[element] and held[element] <= held[0] / 2
            if how == "maybe":
                counts &= all_text[element] <= SHORT or linked[element] >= LINKED * all_text[element]
        else:
            continue
        if counts:
            given[element] = element
    around = page.handed_down(given)
    for line in page.lines:
        line.around = around[line.element] > 0


class Lines(HTMLParser):
    """Collects the lines of a page from parser events; text within a block is one line.

    Text in closed elements is left out as it comes, so that a block around them keeps the rest of its line. The
    work is proportional to the page: what is open is counted as it opens and closes, and lines know one element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack = [0]
        self.blocks: list[int] = []
        self.articles: set[int] = set()
        self.open: dict[str, int] = {}
        self.words: list[str] = []
        self.linked = self.tags = 0

    def has(self, name: str) -> int:
        return self.open.get(name, 0)

    def count(self, element: int, by: int) -> None:
        names = [self.page.tag[element]]
        if self.page.mark[element] == "closed":
            names.append("#closed")
        if element in self.articles:
            names.append("#article")
        for name in names:
            self.open[name] = self.open.get(name, 0) + by

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            element = self.stack[-1]
            self.page.lines.append(Line(text, self.tags, self.linked, element, any(self.has(f"h{i}") for i in (1, 2))))
            self.tags = 0
        self.words, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.words.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in _ENDS or tag == "p" or re.fullmatch("h[1-6]", tag):
            self.implied(tag)
        page, given = self.page, {k: v or "" for k, v in attrs}
        element = len(page.parent)
        page.parent.append(self.stack[-1])
        page.tag.append(tag)
        page.mark.append(marked(tag, given, self.has("#article") > 0))
        if tag in ARTICLE or given.get("itemprop") == "articleBody" or given.get("role") == "main":
            page.articles.append(element)
            self.articles.add(element)
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        self.count(element, 1)

    def implied(self, tag: str) -> None:
        """Closes an element that this tag ends although its own end tag is missing."""
        if self.blocks and self.page.tag[self.stack[self.blocks[-1]]] in _ENDS.get(tag, ("p",)):
            self.cut(self.blocks[-1])

    def cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.count(element, -1)
        del self.stack[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if not self.has(tag):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.page.tag[self.stack[at]] == tag:
                self.cut(at)
                return

    def handle_data(self, data: str) -> None:
        if self.has("#closed"):
            return
        self.words.append(data)
        if self.has("a"):
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self.flush()
        settle(self.page)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing whose weights add up to 1 at the ends too."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(ratios, kernel, mode="full")[reach : reach + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel, mode="full")[reach : reach + len(ratios)]


def threshold(ratios: np.ndarray, share: float = SHARE) -> float:
    """Share of the ratios' standard deviation; a paragraph counts as LONG at most, so that one alone cannot lift it."""
    return share * np.minimum(ratios, LONG).std()


def ratios_of(lines: list[Line]) -> np.ndarray:
    return np.array([0.0 if x.around else len(x.text) / max(1, x.tags) for x in lines])


def select(lines: list[Line], sigma: float = SIGMA, share: float = SHARE) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio reaches the threshold and that nothing marks as surroundings."""
    ratios = ratios_of(lines)
    return (smoothed(ratios, sigma) >= threshold(ratios, share)) & (ratios > 0)


def span(lines: list[Line], among: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The lines among these from the first chosen one to the last; those not chosen only if they are not mostly links."""
    at = np.flatnonzero(among & chosen)
    if not len(at):
        return np.zeros(len(lines), bool)
    plain = np.array([not x.around and x.linked < LINKED * len(x.text) for x in lines])
    out = among & (chosen | plain)
    out[: at[0]] = out[at[-1] + 1 :] = False
    return out


def container(page: Page, chosen: np.ndarray) -> np.ndarray:
    """The lines of the deepest element that holds all clusters and can hold several lines, less its surroundings.

    A line that its neighbours' ratios alone have lifted does not decide on the element. Menus go: lines mostly in
    links, if two or more such lines make up most of the element around them, or if they stand before or after all
    clusters and the element is the whole page. A first or second heading just before the element, in the same
    one, belongs to it.
    """
    lines = page.lines
    ratios = ratios_of(lines)
    core = chosen & (ratios >= threshold(ratios))
    core = core if core.any() else chosen
    weight = page.summed(page.by_line([float(y) for y in core]))
    best = max((e for e in range(len(weight)) if weight[e] == weight[0] and page.tag[e] not in LINE and (not e or page.tag[e] in BLOCKS)), default=0)
    under = page.handed_down({best: 1})
    within = np.array([best == 0 or under[x.element] == 1 for x in lines])
    size, linked, several = (
        page.summed(page.by_line(x)) for x in ([float(len(x.text)) for x in lines], [float(x.linked) for x in lines], [1.0] * len(lines))
    )

    whole = best == 0 or page.tag[best] in ("html", "body")
    at = np.flatnonzero(core)

    def menu(line: Line, number: int) -> bool:
        if line.linked < LINKED * len(line.text):
            return False
        if whole and not at[0] <= number <= at[-1]:
            return True
        around = line.element
        while around and several[around] < 2:
            around = page.parent[around]
        return around != best and around > 0 and linked[around] >= LINKED * size[around]

    keep = within & np.array([not x.around and not menu(x, i) for i, x in enumerate(lines)])
    first = int(np.flatnonzero(within)[0])
    if best and first and not any(x.heading for x, yes in zip(lines, keep, strict=True) if yes):
        title = lines[first - 1]
        keep[first - 1] = title.heading and not title.around and page.parent[title.element] == page.parent[best]
    return keep


def region(page: Page, chosen: np.ndarray) -> list[Line]:
    """The lines of the content region, in page order.

    The region is the article element that holds most of the chosen text, whole, and what is chosen outside it
    without its lines' help and is not mostly links: in every other article, and in the rest of the page, from the
    first such line to the last. Without an article, or if it holds little, it is the deepest container of all
    chosen lines, whole. Short lines between the clusters belong to it, what marks itself as surroundings does not.
    """
    lines = page.lines
    inside = page.summed(page.by_line([float(len(x.text)) if y else 0.0 for x, y in zip(lines, chosen, strict=True)]))
    articles = [n for n in page.articles if inside[n] > 0]
    best = max(articles, key=lambda n: (inside[n], n), default=0)
    if not best or inside[best] < LEAST * inside[0]:
        return [x for x, yes in zip(lines, container(page, chosen), strict=True) if yes] if chosen.any() else []
    under = page.handed_down({best: best})
    within = np.array([under[x.element] == best for x in lines])
    keep = within & np.array([not x.around for x in lines])
    ratios = ratios_of(lines)
    alone = np.where(within, 0.0, ratios)
    menu = np.array([x.linked >= LINKED * len(x.text) for x in lines])
    more = chosen & ~within & ~menu & (smoothed(alone) >= threshold(ratios))
    outer = outermost(page, articles)
    group = np.array([outer[x.element] for x in lines])
    for n in set(group[more].tolist()):
        keep |= span(lines, (group == n) & ~within, more)
    return [x for x, yes in zip(lines, keep, strict=True) if yes]


def outermost(page: Page, articles: list[int]) -> list[int]:
    """For each element the outermost of these articles that it lies in, else 0."""
    among, out = set(articles), [0] * len(page.parent)
    for element in range(1, len(out)):
        out[element] = out[page.parent[element]] or (element if element in among else 0)
    return out


def main_text(html: str | None) -> str:
    """The article of a page, a line for each block with an empty one between; empty if there is none."""
    parser = Lines()
    parser.feed(_CUT.sub("", html or ""))
    parser.close()
    page = parser.page
    if not page.lines:
        return ""
    return "\n\n".join(x.text for x in region(page, select(page.lines)))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. Null and empty pages have the empty text; repeated rows stay;
    whole pages are read, nothing is cut; other columns are ignored."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(x) for x in series], dtype=object)

    rows = pick(pages, page_id=page_id, url=url, html=html)
    return rows.select("page_id", "url", run("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
