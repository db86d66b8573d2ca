"""Main text of web pages by the distribution of line blocks.

Markup is stripped so that each block element gives a line (character
references decoded, white space to one space). Lines inside menus, page
headers and footers, sidebars, notices, adverts, forms and reader comments
count as blank. The lengths of the other lines, and their sums over windows of
WINDOW lines, are the page's distribution: it surges where the article is and
dives to nothing before and after.

The region is chosen by the distribution. Text of surging lines is summed up
for every element, and from the page's root the region descends into an element
while that holds REGION of the page's surging text; it ends at an element that
holds several blocks, grows over parents that add headings and paragraphs only,
and to the <article> or <main> around it. No block of the region is dropped.
Where no element below the body holds as much, what lies between two dives of
the body's windows with a surge is kept. Blocks of other <article> and <main>
elements are kept too.

Elements end where the HTML standard has them end: by their own end tag, by a
start tag that implies it (p, li, dd, dt, option, table parts, headings, head)
or with an element that was open before them. What is left out ends so too, and
at <main>, which no such element can hold; if its end tag is missing, also at
<article> (the page is then read twice).

A surge is a window (a surging line: a line) of SURGE characters, or half of the
page's fullest if that is less, so that a page with little text keeps it.

What is left out never takes the article with it: an element that holds all
article and main elements and most of the page's text, or most of the text
where next to nothing is left, is kept (a form or a marked wrapper around the
page).

Defined results: null and empty html give an empty text; html cut off in the
middle is read as far as it goes; equal rows give equal texts; an empty table
gives no rows; input columns with the name of a result column are replaced.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import widened, without

WINDOW = 3
SURGE = 80
LINK_SHARE = 0.7
REGION = 0.8  # share of the page's surging text that the region's element holds

# Elements of the HTML standard by their part in a page.
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video math".split())
ASIDE = frozenset("nav header footer aside form button select textarea dialog menu".split())
NEVER = UNSEEN | frozenset("nav footer menu button select textarea".split())  # hold no article
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup li dt dd blockquote pre figcaption caption td th address summary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words that mark what is not the article, as a class, id or role of their own or
# joined to each other and to words of PLACES only ("site-footer", "ad_box_2", not "no-sidebar").
PLACES = frozenset(
    "area bar bars block body bottom box boxes button buttons center col column container content cookie count entry form global group "
    "icon icons inner item items left link links list main middle module outer page panel post primary right row secondary section "
    "side site slot slots text title top unit units user wrap wrapper zone".split())
MARKS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disclaimer footer header masthead menu nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget alert complementary contentinfo search disqus".split())

TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open p, and those that may stand in a head.
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header "
    "hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
# Start tag: the open elements that it ends, the nearest with all inside it.
ENDS = {
    **{t: ("p",) for t in ENDS_P}, "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"),
    "option": ("option",), "optgroup": ("optgroup", "option"), "button": ("button",), "select": ("select",),
    "td": ("td", "th", "caption"), "th": ("td", "th", "caption"), "tr": ("tr", "caption", "colgroup"),
    **{t: ("thead", "tbody", "tfoot", "caption", "colgroup") for t in ("thead", "tbody", "tfoot")},
}
IMPLIED = frozenset(t for ended in ENDS.values() for t in ended)
# Elements that hide what is open around them: from all, from end tags of other
# elements too; from a p; from an li, dd or dt.
SCOPE = frozenset("table td th caption object template svg math".split())
HIDES_P = SCOPE | {"button"}
HIDES_ITEM = SCOPE | {"ul", "ol", "dl", "menu", "dir"}
HIDES_ITEM |= frozenset(
    "article aside blockquote button center details fieldset figcaption figure footer form header hgroup main nav "
    "pre section select summary".split()) | HEADINGS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = re.compile(r"\s+")
WORD_BREAK = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")


def is_mark(name: str) -> bool:
    words = [w for w in map(str.lower, WORD_BREAK.split(name)) if w and not w.isdigit()]
    return any(w in MARKS for w in words) and all(w in MARKS or w in PLACES for w in words)


class Lines(HTMLParser):
    """Lines of a page: [text, characters in links, inside article or main,
    number of the innermost element]. Element 0 is the page."""

    def __init__(self, unclosed: frozenset = frozenset(), wanted: frozenset = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.known = unclosed  # where the page has start tags whose end tags are missing
        self.wanted = wanted  # where elements start that must not be left out
        self.parents, self.tags = [0], [""]  # of each element
        self.numbers: list[int] = []  # of the open elements
        self.chars = self.articles = self.unseen = 0  # text so far; article and main elements; open UNSEEN ones
        # Of the open elements: chars and articles before, whether it would be left out, whether inside an article.
        self.before: list[tuple[int, int, bool, bool]] = []
        self.refused: list[tuple[tuple[int, int], int, int, bool, bool]] = []  # elements that would be left out: start, chars, articles, inside, closed
        self.unclosed: set[tuple[int, int]] = set()
        self.doubtful = False  # whether an article was left out
        self.starts: list[tuple[int, int]] = []  # of the open elements
        self.lines: list[list] = []
        self.text: list[str] = []
        self.linked = 0
        self.in_link = False
        # Open elements but for inline ones: tag, the place of the nearest
        # element that hides those around it, the places of the open elements
        # in sight that a start tag may end.
        self.open: list[tuple[str, int, dict[str, int]]] = []
        self.places: dict[str, list[int]] = {}  # by tag
        self.skip = -1  # the place of the element whose content is left out
        self.seen_article = 0

    def end_line(self, blank: bool = False) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text or blank:
            self.lines.append([text, self.linked, self.in_article(), self.numbers[-1] if self.numbers else 0])
        self.text, self.linked = [], 0

    def in_article(self) -> bool:
        return bool(self.places.get("article") or self.places.get("main"))

    def push(self, tag: str, refused: bool = False) -> None:
        at = len(self.open)
        self.before.append((self.chars, self.articles, refused, self.in_article()))
        self.parents.append(self.numbers[-1] if self.numbers else 0)
        self.numbers.append(len(self.tags))
        self.tags.append(tag)
        self.unseen += tag in UNSEEN
        self.articles += tag in ("article", "main")
        _, hidden, near = self.open[-1] if at else ("", -1, {})
        if tag in SCOPE:
            # The parts of a table end one another, but not through a cell's table.
            hidden, near = at, {} if tag == "table" or tag not in TABLE_PARTS else {k: v for k, v in near.items() if k in TABLE_PARTS}
        elif near and tag in HIDES_ITEM:
            near = {k: v for k, v in near.items() if k not in ("li", "dd", "dt") and (k != "p" or tag not in HIDES_P)}
        if tag in IMPLIED:
            near = {**near, tag: at}
        self.open.append((tag, hidden, near))
        self.starts.append(self.getpos())
        self.places.setdefault(tag, []).append(at)

    def close_from(self, at: int) -> None:
        """Ends the open element at a place and all inside it."""
        if self.skip < 0:
            self.end_line()
        for k in range(len(self.open) - 1, at - 1, -1):
            tag = self.open[k][0]
            self.places[tag].pop()
            self.unseen -= tag in UNSEEN
            self.note(k, k == at or tag in IMPLIED)
        if len(self.open) - at > 1:
            self.unclosed.update(s for s, e in zip(self.starts[at + 1:], self.open[at + 1:]) if e[0] not in IMPLIED)
        del self.open[at:], self.starts[at:], self.numbers[at:], self.before[at:]
        if self.skip >= at:
            self.skip = -1
            self.end_line(blank=True)

    def note(self, k: int, closed: bool) -> None:
        """Remember how much an open element held that is or would be left out."""
        chars, articles, refused, inside = self.before[k]
        if refused and self.open[k][0] not in NEVER:
            self.refused.append((self.starts[k], self.chars - chars, self.articles - articles, inside, closed))

    def end_implied(self, tag: str) -> None:
        if tag not in IN_HEAD and self.places.get("head"):
            self.close_from(self.places["head"][-1])
        if not self.open:
            return
        if self.skip >= 0 and tag in ("main", "article") and self.open[self.skip][0] not in UNSEEN:
            if tag == "main" or self.starts[self.skip] in self.known:
                self.close_from(self.skip)
            else:
                self.doubtful = True
        near = self.open[-1][2] if self.open else {}
        ended = [near[t] for t in ENDS.get(tag, ()) if t in near]
        if ended:
            self.close_from(min(ended))
        elif tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.close_from(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            if self.places.get("head"):
                self.close_from(self.places["head"][-1])
            if self.skip < 0:
                self.text.append(" " if tag == "br" else "")
                self.in_link = self.in_link or tag == "a"
            return
        self.end_implied(tag)
        if self.skip >= 0:
            if tag not in VOID:
                self.push(tag, tag not in ("html", "body", "article", "main") and self.left_out(tag, attrs))
            return
        self.end_line()
        self.in_link = False
        self.seen_article += tag == "article"
        if tag in VOID or (tag in ("html", "body") and self.places.get(tag)):
            return
        refused = tag not in ("html", "body", "article", "main") and self.left_out(tag, attrs)
        self.push(tag, refused)
        if refused and self.starts[-1] not in self.wanted:
            self.skip = len(self.open) - 1

    def left_out(self, tag: str, attrs: list) -> bool:
        if tag in UNSEEN:
            return True
        if tag in ASIDE:
            # The head of an article holds its title.
            return tag != "header" or not self.seen_article
        said = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).split()
        if self.seen_article:  # as for header elements
            said = [x for x in said if not x.lower().endswith(("header", "masthead"))]
        return any(map(is_mark, said))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self.skip < 0 and tag not in INLINE:
            self.end_line()
        elif self.skip < 0 and tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.skip < 0:
            self.in_link = False
        if tag in INLINE:
            return
        if self.skip < 0:
            self.end_line()
        at = self.places.get(tag)
        # Inside a table's cell, end tags of what is around the table have no effect.
        if at and (at[-1] >= self.open[-1][1] or tag in TABLE_PARTS or tag in SCOPE or tag in ("html", "body")):
            self.close_from(at[-1])

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.close_from(len(self.open) - 1)
        if not self.unseen:
            self.chars += len(data.strip())
        if self.skip < 0:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self.end_line()
        self.unclosed.update(s for s, e in zip(self.starts, self.open) if e[0] not in IMPLIED)
        for k, e in enumerate(self.open):
            self.note(k, e[0] in IMPLIED)
        return self.lines

    def too_much(self) -> frozenset:
        """Where elements start that were left out with the article in them: with
        all article and main elements and most of the page's text, or with most of
        the text where next to nothing is left."""
        left = sum(len(x[0]) for x in self.lines)
        sums = padded_lengths(self.lines)
        little = 10 * left < self.chars and max(map(sum, zip(*[sums[k:] for k in range(WINDOW)])), default=0) < SURGE and not any(
            x[2] and x[0] for x in self.lines)
        return frozenset(
            start for start, chars, articles, inside, closed in self.refused if 2 * chars > self.chars and not inside
            and ((closed and articles == self.articles > 0) or (little and chars >= SURGE and (closed or not articles))))


def read_page(html: str) -> Lines:
    """A page's lines; it is read again where the first reading shows that an
    element without end tag, or one left out, holds the article."""
    page = Lines()
    page.read(html)
    known = frozenset(page.unclosed) if page.doubtful else frozenset()
    if known:
        page = Lines(known)
        page.read(html)
    wanted = page.too_much()
    if wanted:
        page = Lines(known, wanted)
        page.read(html)
    return page


def padded_lengths(lines: list[list]) -> list[int]:
    """Lengths of the lines, as if the page had blank lines around it."""
    return [0] * (WINDOW - 1) + [len(x[0]) for x in lines] + [0] * (WINDOW - 1)


def surging(texts: list[str]) -> list[bool]:
    """Whether each text lies between two dives with a surge: stretches of windows
    that are not empty, one of them with SURGE characters, or half of the
    fullest window's if that is less."""
    lengths = padded_lengths([[t] for t in texts])
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths) - WINDOW + 1)]
    surge = min(SURGE, max(sums, default=0) / 2)
    out, start, surged = [False] * len(texts), 0, False
    for i in range(len(texts) + 1):
        # The windows that hold line i start at padded lines i to i + WINDOW - 1.
        around = sums[i:i + WINDOW] if i < len(texts) else [0]
        if any(around):
            surged = surged or max(around) >= surge > 0
        else:
            out[start:i] = [surged] * (i - start)
            start, surged = i + 1, False
    return out


def region(page: Lines) -> int:
    """The element that holds the article (0: the page, or its body)."""
    lengths = [len(text) if linked <= LINK_SHARE * len(text) else 0 for text, linked, _, _ in page.lines]
    least = min(SURGE, max(lengths, default=0) / 2)
    weight = [0] * len(page.tags)
    for (text, _, _, at), n in zip(page.lines, lengths):
        weight[at] += n if n >= least else 0
    for k in range(len(page.tags) - 1, 0, -1):
        weight[page.parents[k]] += weight[k]
    if not weight[0]:
        return 0
    heavy: dict[int, int] = {}
    for k in range(1, len(page.tags)):
        if weight[k] >= REGION * weight[0]:
            heavy[page.parents[k]] = k
    at = 0
    while at in heavy:
        at = heavy[at]
    while at and page.tags[at] in TEXT_BLOCKS:
        at = page.parents[at]
    # Grow over parents whose other lines are in text blocks right in them.
    own = [0] * len(page.tags)  # lines right in an element
    for text, _, _, k in page.lines:
        own[k] += bool(text)
    held, parts = own.copy(), {}  # lines in it; the elements right in it that hold lines
    for k in range(len(page.tags) - 1, 0, -1):
        held[page.parents[k]] += held[k]
        if held[k]:
            parts.setdefault(page.parents[k], []).append(k)
    while at and page.tags[at] not in ("body", "html"):
        up = page.parents[at]
        if not up or page.tags[up] in ("body", "html"):
            return at
        if not all(k == at or (page.tags[k] in TEXT_BLOCKS and own[k] == held[k]) for k in parts[up]):
            return at
        at = up
    return 0


def subtree(page: Lines, at: int) -> list[bool]:
    """Whether each element is ``at`` or inside it."""
    inside = [False] * len(page.tags)
    inside[at] = True
    for k in range(at + 1, len(page.tags)):
        inside[k] = inside[page.parents[k]]
    return inside


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    page = read_page(html or "")
    lines = page.lines
    at = region(page)
    if at:
        inside = subtree(page, at)
        kept = [inside[x[3]] or x[2] for x in lines]
        first = next(i for i, keep in enumerate(kept) if keep)
        while first and page.tags[lines[first - 1][3]] in HEADINGS:  # its title stands before it
            first -= 1
            kept[first] = True
    else:
        texts = ["" if not within and linked > LINK_SHARE * len(text) else text for text, linked, within, _ in lines]
        kept = [(s and bool(t)) or x[2] for s, t, x in zip(surging(texts), texts, lines)]
    return "\n\n".join(x[0] for x, keep in zip(lines, kept) if keep and x[0])


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (html, ...) with text and n_chars."""
    pages = without(pages, "text", "n_chars")

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "text"])

    return pages.mapInArrow(run, widened(pages, ("text", "string"))).withColumn(
        "n_chars", F.char_length("text").cast("long"))
