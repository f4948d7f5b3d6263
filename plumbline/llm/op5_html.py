"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering.

The standard library's parser streams over a page.  Block elements end a line;
inline markup only adds to its count of tags.  Elements that never hold the
article (scripts, forms, menus and so on, by their tag or role) are passed over
with all they contain, unless one turns out to be round the article: it has the
page's only article or main element inside, or nearly all of its text, not mostly
links (a form round the page, a menu or button left open).  So are elements by a name in their class or id, but no
name alone takes much of a page: a first reading counts the text of the named
elements.  Names of marking words alone (``WORDS``, with ``NEUTRAL`` ones) rule out
an element with less than nearly all of the page's text (``MOST``), or one that has
nothing to do with the page's article or main element; names with other words in them
only an element that is mostly links, and ``MODIFIERS`` take a name's meaning.  If
nothing is left, the names count for nothing.

Each remaining line has a ratio of text to tags.  The ratios are smoothed with
a Gaussian window; lines at or over the threshold, the ratios' standard
deviation, are the content cluster.  Where the articles (else the main elements)
hold half of the cluster's text, all of them together are the region; otherwise
it is the innermost container of blocks that holds every line of the cluster and
every line that is not mostly links.  The main text is every line of the region,
short ones too, so nothing of the article is lost to the threshold.

Cases: a null or empty page gives an empty text, and so does one without any
line; broken markup is read as far as the parser goes and its brackets as
text; repeated pages give equal results; a page of any length is read whole;
an empty table gives an empty result; other columns are not read.  Time and memory
grow with a page's length alone, however deep its elements nest.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import by_batches, read

RADIUS, SIGMA = 2, 1.0
MOST, HALF = 0.9, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead title tr ul""".split()
)
PASSED = frozenset(
    """applet aside audio button canvas datalist dialog embed fieldset footer form frameset head header iframe input
    label menu meter nav noembed noframes noscript object option output progress script select style svg template
    textarea title video""".split()
)
# Of these the ones whose text is seen: one may turn out to be round the article.
READABLE = frozenset("button dialog fieldset footer form header label menu nav object".split())
DEEPER = 4
CONTENT = frozenset("html body main article".split())
CONTAINERS = frozenset("html body main article section div center table tbody td".split())
# Words of a class or id that mark what is not the article.
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion
    banner cookie cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb
    breadcrumbs header masthead footer comment comments disqus reply replies respond share sharing social related
    recommended newsletter subscribe signup popup modal overlay login search widget widgets toolbar pagination pager
    copyright skip""".split()
)
# Words beside them that change nothing, and first words of names that tell of something elsewhere on the page.
NEUTRAL = frozenset(
    """area bar block bottom box button buttons center col column container content global group icons inner item
    items left link links list main middle outer page panel primary right row secondary section site small text top
    unit wrap wrapper""".split()
)
MODIFIERS = frozenset("has have with without no not hide is can".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu".split())
# What a new element ends, as the end tag may be left out.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table article section main div body html".split())
SPLIT = re.compile(r"[^a-z0-9]+")


class Lines(HTMLParser):
    """Lines of a page as ``(text, tags, innermost open container, characters in links)``.

    Elements are numbered as they open, so those inside an element have the
    numbers after its own up to ``last`` of it.
    """

    def __init__(self, named_out: frozenset[int] | None = None, taken_back: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.named_out = named_out  # named elements to pass over; None in a first reading
        self.taken_back = taken_back  # elements that are read in spite of their tag
        self.named: dict[int, list] = {}  # of each: whether its name is sure, characters, characters in links
        self.inside: list[tuple[int, int]] = []  # depth and number of the open ones
        self.marked = False  # whether there is an article or main element
        self.beside: set[int] = set()  # named elements around or in one
        self.total = 0
        self.total_links = 0
        self.passed: dict[int, list] = {}  # of each element passed over by its tag: characters, those in links, whether it is marked
        self.open: list[tuple[str, int]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements by tag
        self.scopes: list[int] = []  # depths of the open elements beyond which no tag is implied
        self.containers: list[int] = []  # numbers of the open containers
        self.passing = 0  # depth of the element that is passed over, else 0
        self.lines: list[tuple[str, int, int, int]] = []
        self.names: dict[int, str] = {}
        self.last: dict[int, int] = {}
        self.above: dict[int, int] = {}  # the container around an element, 0 for none
        self.parents: set[int] = set()  # elements with blocks inside
        self.text: list[str] = []
        self.tags = 0
        self.links = 0  # characters of the line that are in links
        self.linked = False
        self.count = 0

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                at = self.containers[-1] if self.containers else 0
                self.lines.append((line, self.tags, at, self.links))
                self.tags = 0
            self.text, self.links = [], 0
        self.linked = False  # a link left open ends with its line at the latest

    def close_to(self, depth: int) -> None:
        for tag, number in self.open[depth:]:
            self.last[number] = self.count
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            if tag in CONTAINERS:
                self.containers.pop()
        del self.open[depth:]
        while self.inside and self.inside[-1][0] > depth:
            # What was read since the element opened; both sums were taken off then.
            held = self.named[self.inside.pop()[1]]
            held[1] += self.total
            held[2] += self.total_links
        if self.passing and depth < self.passing:
            self.passing = 0

    def close(self) -> None:
        super().close()
        self.end_line()
        self.close_to(0)

    def end_implied(self, tag: str) -> None:
        ends = ENDS.get(tag, {"p"} if tag in BLOCKS else ())
        inner = max((self.places[t][-1] for t in ends if self.places[t]), default=-1)
        if inner > (self.scopes[-1] if self.scopes else -1):
            self.close_to(inner)

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self.end_line()
            self.end_implied(tag)
            if self.open:
                self.parents.add(self.open[-1][1])
        self.tags += 1
        if tag == "a":
            self.linked = any(name == "href" for name, _ in attrs)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID or not (block or tag in PASSED or attrs):
            return
        self.count += 1
        name = named(attrs) if attrs and tag not in CONTENT else None
        if not block and tag not in PASSED and name is None and not unwanted(attrs):
            return
        self.places[tag].append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((tag, self.count))
        self.names[self.count] = tag
        if tag in CONTAINERS:
            self.above[self.count] = self.containers[-1] if self.containers else 0
            self.containers.append(self.count)
        out = tag in PASSED or (tag not in CONTENT and attrs and unwanted(attrs))
        if self.passing and tag in ("article", "main"):
            self.passed[self.open[self.passing - 1][1]][2] = True
        if not self.passing and out and self.count not in self.taken_back:
            self.passing = len(self.open)
            self.passed[self.count] = [0, 0, False]
        elif not self.passing and tag in ("article", "main"):
            self.marked = True
            self.beside.update(e for _, e in self.inside)
        elif not self.passing and name is not None:
            if self.named_out is None:
                if self.marked and any(t in ("article", "main") for t, _ in self.open):
                    self.beside.add(self.count)
                self.named[self.count] = [name, -self.total, -self.total_links]
                self.inside.append((len(self.open), self.count))
            elif self.count in self.named_out:
                self.passing = len(self.open)
                self.passed[self.count] = [0, 0, False]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in PASSED and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.linked = False
        if tag in BLOCKS:
            self.end_line()
        if self.places[tag]:
            self.close_to(self.places[tag][-1])

    def handle_data(self, data):
        if not self.passing:
            self.text.append(data)
            self.links += self.linked * len(data)
            size = len("".join(data.split()))
            self.total += size
            self.total_links += self.linked * size
        elif self.open[-1][0] in READABLE or self.names[self.open[self.passing - 1][1]] in READABLE:
            held, size = self.passed[self.open[self.passing - 1][1]], len("".join(data.split()))
            held[0] += size
            held[1] += self.linked * size

    def unknown_decl(self, data):
        pass


def unwanted(attrs) -> bool:
    for name, value in attrs:
        if name == "role" and value and value.lower() in ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def named(attrs) -> bool | None:
    """Whether a name of the class or id surely marks what is not the article; None if none may."""
    found = None
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.lower().split():
                words = [w for w in SPLIT.split(name) if w and not w.isdigit()]
                if words and words[0] not in MODIFIERS and not WORDS.isdisjoint(words):
                    found = found or all(w in WORDS or w in NEUTRAL for w in words)
    return found


def named_out(page: Lines) -> frozenset[int]:
    """Named elements to pass over: those that do not hold the article by what is in them."""
    return frozenset(
        e
        for e, (sure, size, links) in page.named.items()
        if ((size < MOST * page.total or (page.marked and e not in page.beside)) if sure else size and links >= HALF * size)
    )


def taken_back(page: Lines) -> frozenset[int]:
    """Elements passed over by their tag that hold the page's article: a form round all of it, a menu left open.

    Those with an article or main element inside, where there is none outside;
    else one that holds nearly all of the page's text and is not mostly links.
    """
    if page.marked:
        return frozenset()
    read = {e: held for e, held in page.passed.items() if page.names[e] in READABLE}
    around = frozenset(e for e, held in read.items() if held[2])
    whole = page.total + sum(held[0] for held in read.values())
    return around or frozenset(e for e, (size, links, _) in read.items() if size and size >= MOST * whole and links < HALF * size)


def read_page(html: str) -> Lines:
    back: frozenset[int] = frozenset()
    first = read_lines(html, None, back)
    # Each reading goes one such element deeper; a few are enough for a form in a form.
    for _ in range(DEEPER):
        more = taken_back(first) - back
        if not more:
            break
        back |= more
        first = read_lines(html, None, back)
    out = named_out(first)
    if not out:
        return first
    second = read_lines(html, out, back)
    return second if second.lines else first


def read_lines(html: str, out: frozenset[int] | None, back: frozenset[int]) -> Lines:
    for page in (html, html.replace("<!", "&lt;!"), html.replace("<", "&lt;")):
        parser = Lines(out, back)
        try:
            parser.feed(page)
            parser.close()
        except (AssertionError, ValueError):  # markup that the parser refuses
            continue
        return parser
    return Lines(out, back)


WINDOW = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for k in range(len(ratios)):
        total = weight = 0.0
        for step, w in enumerate(WINDOW, k - RADIUS):
            if 0 <= step < len(ratios):
                total += w * ratios[step]
                weight += w
        out.append(total / weight)
    return out


def region(page: Lines) -> set[int] | None:
    """The elements that hold the content cluster, or None for the whole page."""
    ratios = [len(text) / max(1, tags) for text, tags, *_ in page.lines]
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    inside = [r >= threshold for r in smoothed(ratios)]
    if not any(inside):
        inside = [True] * len(ratios)
    total = sum(len(text) for (text, *_), chosen in zip(page.lines, inside, strict=True) if chosen)
    for tag in ("article", "main"):
        outer = outermost(page, tag)
        found, weight = set(), 0
        for (text, _, at, _), chosen in zip(page.lines, inside, strict=True):
            if outer.get(at):
                found.add(outer[at])
                weight += len(text) * chosen
        if found and weight >= HALF * total:
            return found
    common = None
    for (text, _, at, links), chosen in zip(page.lines, inside, strict=True):
        if chosen or links < HALF * len(text):
            common = at if common is None else common
            while common and not common <= at <= page.last[common]:
                common = page.above[common]
    while common and common not in page.parents:
        common = page.above[common]
    return {common} if common else None


def outermost(page: Lines, tag: str) -> dict[int, int]:
    """For each container the outermost element of a tag that it is or lies in."""
    outer: dict[int, int] = {}
    for number, above in page.above.items():  # in the order they opened
        held = outer.get(above) or (number if page.names[number] == tag else 0)
        if held:
            outer[number] = held
    return outer


def main_text(html: str | None) -> str:
    page = read_page(html or "")
    if not page.lines:
        return ""
    chosen = region(page)
    if chosen is None:
        return "\n".join(text for text, *_ in page.lines)
    # Regions don't overlap: the last that opened at or before a line's container is the only one that may hold it.
    starts = sorted(chosen)
    kept = []
    for text, _, at, _ in page.lines:
        k = bisect_right(starts, at)
        if k and at <= page.last[starts[k - 1]]:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""

    def work(batches):
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return by_batches(rows, work, f"page_id {kind}, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
