"""Indicator extraction and last-known-good cache.

Pages arrive as a table ``(page_id, ticker, final_url, status, ts, html)``.
One Arrow-batched ``mapInPandas`` step parses each page once with the
standard library's ``html.parser`` and returns only the raw strings the
selectors pick (a few short arrays per page, never the page text). The
cascade — last card wins, first parsable table row, text fallback only when
the table exists — and the number parsing are column expressions.

The refresh (H8) is the Structured Streaming job in
``quotaflow.streaming.refresh``; ``latest`` here is its batch twin.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotaflow.functions import text as T

# Fixed values (must equal the reference's).
HOME_URL = "https://investidor10.com.br/"
VP_KEY = "PATRIMONIAL P/ COTA"
DY_CARD_KEY = "DY"
DY_TABLE_KEY = "DIVIDEND YIELD"
TABLE_ID = "table-indicators"
TEXT_VP_PATTERN = r"(?:Patrimonial\s*p/?\s*cota|VPA).*?R\$\s*([\d.,]+)"
SOURCE_CACHE, SOURCE_LIVE, SOURCE_MISSING = "cache", "live", "not_found"

EXTRACT_SCHEMA = (
    "page_id long, ticker string, ts timestamp, hit boolean, has_table boolean, "
    "cell_vp array<string>, card_dy array<string>, table_keys array<string>, table_vals array<string>, "
    "text_vp string, quote_raw string"
)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "keygen", "menuitem",
         "nextid", "spacer"}
_HIDDEN_TEXT = {"script", "style", "template"}
# The two ends of TEXT_VP_PATTERN, looked for apart.
_TEXT_LABEL = re.compile(TEXT_VP_PATTERN.split(".*?")[0], re.IGNORECASE)
_TEXT_AMOUNT = re.compile(TEXT_VP_PATTERN.split(".*?")[1], re.IGNORECASE)
# A letter that no number's text has (it may have those of R$, exponents, inf and nan).
_OTHER_LETTER = re.compile(r"(?![RinftyaeINFTYAE])[^\W\d_]")


class _Page(HTMLParser):
    """A page as flat lists in document order, read in one pass with a stack of
    open elements (no recursion, so any depth): an end tag closes the nearest
    open element of that name (unclosed ones inside it too), stray end tags are
    ignored, void elements hold nothing. Text under script, style and template
    and comments is not page text.

    Every element has the interval of places (elements and strings counted
    together) it spans; what lies inside an element is what lies in its interval.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.place = 0
        self.ends = {}  # place of an element -> place after its last descendant
        self.open = []  # (tag, place, inside div.value, inside the quote card, inside its div.value)
        self.open_tags = Counter()
        self.strings, self.string_places = [], []
        self.found = {k: [] for k in ("cell", "desc", "value_span", "card", "head", "body", "tr", "td")}
        self.table = self.quote = None

    def handle_starttag(self, tag, attrs, empty=False):
        at, self.place = self.place, self.place + 1
        d = dict(attrs)
        cls = set((d.get("class") or "").split()) if tag == "div" else ()
        value, card, chain = self.open[-1][2:] if self.open else (False, False, False)
        if tag == "div":
            for kind, name in (("cell", "cell"), ("desc", "desc"), ("card", "_card"), ("head", "_card-header"), ("body", "_card-body")):
                if name in cls:
                    self.found[kind].append(at)
        elif tag == "span":
            if value:
                self.found["value_span"].append(at)
            if chain and self.quote is None:
                self.quote = at
        elif tag in ("tr", "td"):
            self.found[tag].append(at)
        if self.table is None and d.get("id") == TABLE_ID:
            self.table = at
        if empty or tag in _VOID:
            self.ends[at] = self.place
            return
        is_value = "value" in cls
        self.open.append((tag, at, value or is_value, card or ("_card" in cls and "cotacao" in cls), chain or (is_value and card)))
        self.open_tags[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, empty=True)

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            while self._close() != tag:
                pass

    def _close(self):
        tag, at, *_ = self.open.pop()
        self.open_tags[tag] -= 1
        self.ends[at] = self.place
        return tag

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in _HIDDEN_TEXT):
            self.strings.append(data)
            self.string_places.append(self.place)
            self.place += 1

    def read(self, html):
        self.feed(html)
        self.close()
        while self.open:
            self._close()
        self.stripped = [s.strip() for s in self.strings]
        upper = [s.upper() for s in self.stripped]
        self.upper, self.upper_at = "".join(upper), list(accumulate(map(len, upper), initial=0))
        self.letters_at = list(accumulate((bool(_OTHER_LETTER.search(s)) for s in self.stripped), initial=0))
        return self

    def inside(self, kind, at, most=None):
        """The elements of a kind inside the element at ``at``, in order (the
        first ``most``)."""
        places = self.found[kind]
        a, b = bisect_right(places, at), bisect_left(places, self.ends[at])
        return places[a:b if most is None else min(b, a + most)]

    def first(self, kind, at):
        return next(iter(self.inside(kind, at, 1)), None)

    def span(self, at):
        """The strings inside an element, as a range of their numbers."""
        return bisect_left(self.string_places, at), bisect_left(self.string_places, self.ends[at])

    def text(self, at):
        return "".join(self.strings[slice(*self.span(at))])

    def holds(self, key, at):
        """Whether the element's stripped, upper-cased text holds ``key``."""
        a, b = self.span(at)
        found = self.upper.find(key, self.upper_at[a], self.upper_at[b])
        return found >= 0


def _text_value(page):
    """What TEXT_VP_PATTERN captures in the page's text, in one pass: the first
    label that an amount follows on the same line, and the first such amount."""
    text = " ".join(s for s in page.stripped if s)
    amounts = list(_TEXT_AMOUNT.finditer(text))
    starts = [m.start() for m in amounts]
    breaks = [m.start() for m in re.finditer("\n", text)]
    for label in _TEXT_LABEL.finditer(text):
        i = bisect_left(starts, label.end())
        if i == len(starts):
            return None
        if bisect_left(breaks, label.end()) == bisect_left(breaks, starts[i]):
            return amounts[i].group(1)
    return None


def extract_page(html: str) -> dict:
    """Raw strings picked by the reference's selectors from one page. Of the
    table's rows those that may give a value: the key holds one of the two names
    and the value has characters of numbers only."""
    page = _Page().read(html or "")
    cell_vp, card_dy, keys, vals = [], [], [], []
    for at in page.found["cell"]:
        desc = page.first("desc", at)
        if desc is not None and page.holds(VP_KEY, desc):
            value = page.first("value_span", at)
            if value is not None:
                cell_vp.append(value)
    for at in page.found["card"]:
        head = page.first("head", at)
        if head is not None and page.holds(DY_CARD_KEY, head):
            body = page.first("body", at)
            if body is not None:
                card_dy.append(body)
    if page.table is not None:
        for tr in page.inside("tr", page.table):
            cells = page.inside("td", tr, 2)
            if len(cells) < 2:
                continue
            key, value = cells
            a, b = page.span(value)
            named = [k for k in (VP_KEY, DY_TABLE_KEY) if page.holds(k, key)]
            if named and page.letters_at[a] == page.letters_at[b]:
                keys.append(" ".join(named))
                vals.append("".join(page.stripped[a:b]))
    # The last match of a card decides, so its text is all that is returned.
    return {"has_table": page.table is not None, "cell_vp": [page.text(at) for at in cell_vp[-1:]],
            "card_dy": [page.text(at) for at in card_dy[-1:]], "table_keys": keys, "table_vals": vals,
            "text_vp": _text_value(page) if page.table is not None else None,
            "quote_raw": page.text(page.quote) if page.quote is not None else None}


# The extractor travels with each task (pickled by value), so executors need
# no copy of this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


NOTHING = {"has_table": False, "cell_vp": [], "card_dy": [], "table_keys": [], "table_vals": [],
           "text_vp": None, "quote_raw": None}


def _extract_or_miss(html: str | None) -> dict | None:
    """The page's raw fields; None for a page that cannot be read (the parser
    gives up on its markup): a miss, not a failed job."""
    try:
        return extract_page(html)
    except Exception:  # noqa: BLE001 - whatever a page does, the others go on
        return None


def _extract_batches(batches):
    for pdf in batches:
        found = [_extract_or_miss(h) if ok else None for h, ok in zip(pdf["html"], pdf["hit"])]
        out = pd.DataFrame([NOTHING if f is None else f for f in found], columns=list(NOTHING))
        head = pdf[["page_id", "ticker", "ts"]].reset_index(drop=True)
        yield pd.concat([head.assign(hit=[f is not None for f in found]), out], axis=1)


def page_hits(pages: DataFrame) -> DataFrame:
    """A page is found when its status is 200 and it did not redirect to
    the home page; anything else is a miss."""
    return pages.withColumn("hit", (F.col("status") == 200) & (F.coalesce(F.col("final_url"), F.lit("")) != HOME_URL))


def extract(pages: DataFrame) -> DataFrame:
    """H1-H4 raw fields per page (one parse per page, Arrow batches)."""
    return page_hits(pages).select("page_id", "ticker", "ts", "hit", "html").mapInPandas(
        _extract_batches, EXTRACT_SCHEMA)


def _last_parsed(arr: Column) -> Column:
    """Last match wins, even when it does not parse; no match -> null."""
    return F.when(F.size(arr) > 0, T.parse_or_null(F.try_element_at(arr, F.lit(-1))))


def _first_table_value(key: str) -> Column:
    """H3: first row whose key holds ``key`` and whose value parses."""
    parsed = F.transform(F.arrays_zip(F.col("table_keys").alias("k"), F.col("table_vals").alias("v")),
                         lambda r: F.when(r["k"].contains(key), T.parse_or_null(r["v"])))
    return F.try_element_at(F.filter(parsed, lambda x: x.isNotNull()), F.lit(1))


def indicators(raw: DataFrame) -> DataFrame:
    """H5: the cascade per page: cells/cards -> table (only fills what is
    still null) -> page-text VP (only when the table exists). A found page
    with neither value is still a hit; misses are dropped here (see
    ``misses``). Output ``(page_id, ticker, ts, vp, dy)``."""
    vp = F.coalesce(_last_parsed(F.col("cell_vp")), _first_table_value(VP_KEY),
                    F.when(F.col("has_table"), T.parse_or_null(F.col("text_vp"))))
    dy = F.coalesce(_last_parsed(F.col("card_dy")), _first_table_value(DY_TABLE_KEY))
    return raw.where(F.col("hit")).select("page_id", "ticker", "ts", vp.alias("vp"), dy.alias("dy"))


def misses(raw: DataFrame) -> DataFrame:
    """Pages that were not found (status, redirect) or could not be read, kept
    apart, not raised."""
    return raw.where(~F.col("hit")).select("page_id", "ticker", "ts")


def quotes(raw: DataFrame) -> DataFrame:
    """H6: the quote card's value (N4); no card, no page or no number -> 0.0."""
    q = F.when(F.col("hit") & F.col("quote_raw").isNotNull(), T.parse_quote(F.col("quote_raw"))).otherwise(F.lit(0.0))
    return raw.select("page_id", "ticker", q.alias("quote"))


def latest(found: DataFrame) -> DataFrame:
    """H8 batch twin: the latest successful extraction per ticker by
    (ts, page_id). Partial aggregation per map task, so a ticker with a
    third of all pages is cut down before the shuffle."""
    row = F.struct("ts", "page_id", "vp", "dy")
    best = F.max_by(row, F.struct("ts", "page_id"))
    return (found.groupBy("ticker").agg(best.alias("b"))
            .select("ticker", F.col("b.vp").alias("vp"), F.col("b.dy").alias("dy"),
                    F.col("b.ts").alias("ts"), F.col("b.page_id").alias("page_id")))


def lookup(requests: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """H7: requested tickers (trim + upper) -> cached values ('cache'), else
    freshly extracted ones ('live'), else 'not_found' (the left-anti part)."""
    req = requests.select(T.clean_key(F.col("ticker")).alias("ticker")).distinct()
    c = cache.select("ticker", F.col("vp").alias("c_vp"), F.col("dy").alias("c_dy"), F.lit(True).alias("in_cache"))
    f = fresh.select("ticker", F.col("vp").alias("f_vp"), F.col("dy").alias("f_dy"), F.lit(True).alias("in_fresh"))
    return _looked_up(req.join(c, "ticker", "left").join(f, "ticker", "left"))


def _looked_up(j: DataFrame) -> DataFrame:
    src = (F.when(F.col("in_cache"), F.lit(SOURCE_CACHE)).when(F.col("in_fresh"), F.lit(SOURCE_LIVE))
           .otherwise(F.lit(SOURCE_MISSING)))
    return j.select("ticker",
                    F.when(F.col("in_cache"), F.col("c_vp")).otherwise(F.col("f_vp")).alias("vp"),
                    F.when(F.col("in_cache"), F.col("c_dy")).otherwise(F.col("f_dy")).alias("dy"),
                    src.alias("source"))


def known_values(found: DataFrame, cached: Column) -> DataFrame:
    """H7's two sources in one pass over the extracted pages: per ticker the
    latest row among the ``cached`` ones and among all."""
    row, order = F.struct("vp", "dy"), F.struct("ts", "page_id")
    best = found.groupBy("ticker").agg(
        F.max_by(F.when(cached, row), F.when(cached, order)).alias("c"), F.max_by(row, order).alias("f"),
        F.max(F.when(cached, True)).alias("in_cache"))
    return best.select("ticker", F.col("c.vp").alias("c_vp"), F.col("c.dy").alias("c_dy"), "in_cache",
                       F.col("f.vp").alias("f_vp"), F.col("f.dy").alias("f_dy"))


def lookup_pages(requests: DataFrame, found: DataFrame, cached: Column) -> DataFrame:
    """H7 over extracted pages, of which the ``cached`` ones were there before:
    as ``lookup``, with one parse of the pages and one join."""
    req = requests.select(T.clean_key(F.col("ticker")).alias("ticker")).distinct()
    j = req.join(known_values(found, cached).withColumn("in_fresh", F.lit(True)), "ticker", "left")
    return _looked_up(j)


def not_found(requests: DataFrame, found: DataFrame) -> DataFrame:
    """H7 misses: requested tickers that no page gave (left-anti)."""
    req = requests.select(T.clean_key(F.col("ticker")).alias("ticker")).distinct()
    return req.join(found.select("ticker").distinct(), "ticker", "left_anti")


def cache_status(latest_table: DataFrame) -> DataFrame:
    """Number of cached tickers."""
    return latest_table.agg(F.countDistinct("ticker").alias("cached_tickers"))
