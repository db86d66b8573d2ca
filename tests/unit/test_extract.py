"""Indicator extraction quirks (FIXTURES.md section 3: H1, H3, H4, H6)."""

import pytest

from quotaflow.operators import indicators as H


def run(spark, html, status=200):
    df = spark.createDataFrame([(1, "ABCD11", "u", "u", status, None, html)],
                               "page_id long, ticker string, url string, final_url string, status int, ts timestamp, html string")
    raw = H.extract(df)
    ind = H.indicators(raw).collect()
    q = H.quotes(raw).collect()[0].quote
    return (ind[0].vp, ind[0].dy) if ind else None, q


CELL = '<div class="cell"><div class="desc">Valor Patrimonial p/ cota</div><div class="value"><span>{}</span></div></div>'


def test_last_cell_wins_even_unparsable(spark):
    (vp, dy), _ = run(spark, CELL.format("R$ 10,00") + CELL.format("R$ 1 0,00"))
    assert vp is None and dy is None


def test_cell_without_span_changes_nothing(spark):
    html = CELL.format("R$ 10,00") + '<div class="cell"><div class="desc">Valor Patrimonial p/ cota</div></div>'
    (vp, _), _ = run(spark, html)
    assert vp == pytest.approx(10.0)


def test_table_first_parsable_row(spark):
    html = ('<table id="table-indicators"><tr><td>Valor patrimonial p/ cota</td><td>abc</td></tr>'
            '<tr><td>Valor patrimonial p/ cota</td><td>R$ 12,50</td></tr>'
            '<tr><td>Dividend Yield</td><td>9,10%</td></tr></table>')
    (vp, dy), _ = run(spark, html)
    assert vp == pytest.approx(12.5) and dy == pytest.approx(9.1)


def test_text_fallback_needs_table(spark):
    text = "<p>VPA R$ 123,45, hoje</p>"
    (vp, _), _ = run(spark, text)
    assert vp is None
    (vp, _), _ = run(spark, '<table id="table-indicators"></table>' + text)
    assert vp is None  # captured '123,45,' does not parse
    (vp, _), _ = run(spark, '<table id="table-indicators"></table><p>VPA R$ 123,45. hoje</p>')
    assert vp == pytest.approx(123.45)


def test_script_text_is_not_page_text(spark):
    html = '<table id="table-indicators"></table><script>var a = "VPA R$ 9,99";</script><p>nada</p>'
    (vp, _), _ = run(spark, html)
    assert vp is None


def test_missing_page_and_quote(spark):
    res, q = run(spark, CELL.format("R$ 1,00"), status=404)
    assert res is None and q == 0.0
    _, q = run(spark, '<div class="_card cotacao"><div class="value"><span>R$ 1.234,56</span></div></div>')
    assert q == pytest.approx(1234.56)


def test_unreadable_page_is_one_miss(spark):
    from quotaflow.operators import indicators as H

    rows = [(1, "AAAA11", "ok", 200, "", "<p>x</p>"), (2, "BBBB11", "deep", 200, "", "<p>" * 100_000),
            (3, "CCCC11", "gone", 404, "", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, ticker string, ts string, status int, final_url string, html string")
    raw = H.extract(pages.selectExpr("page_id", "ticker", "timestamp'2024-01-01' ts", "status", "final_url", "html"))
    found = {r.page_id for r in H.indicators(raw).collect()}
    missed = {r.page_id for r in H.misses(raw).collect()}
    assert 1 in found and 3 in missed and (2 in found) != (2 in missed)


def test_any_depth_gives_the_values(spark):
    """100,000 elements around, inside and beside the cards cost nothing."""
    deep = "<div><p>" * 50_000
    (vp, dy), q = run(spark, deep + CELL.format("R$ 10,50") + '<div class="_card"><div class="_card-header">DY (12M)</div>'
                      '<div class="_card-body">' + "<b>" * 50_000 + "8,10%</div></div>"
                      + '<div class="_card cotacao"><div class="value">' + "<i>" * 1_000 + "<span>R$ 9,50</span>")
    assert (vp, dy, q) == (pytest.approx(10.5), pytest.approx(8.1), pytest.approx(9.5))


def test_unclosed_and_stray_tags_stay_linear():
    rows = '<tr><td>Dividend Yield<td>x' * 20_000 + '<tr><td>Dividend Yield</td><td>7,5%'
    got = H.extract_page('<table id="table-indicators">' + rows + "</b></tr>" * 50_000)
    assert got["table_vals"] == ["7,5%"]
    nested = H.extract_page('<div class="cell"><div class="desc">' * 20_000 + "Patrimonial p/ cota"
                            + '<div class="value"><span>R$ 3,00')
    assert nested["cell_vp"] == ["R$ 3,00"]
    far = H.extract_page('<p id="table-indicators">' + "VPA " * 50_000 + "\n VPA R$ 5,00")
    assert far["text_vp"] == "5,00"


def by_recursion(html):
    """The same selectors on a plain element tree."""
    import re
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = self.cur = {"tag": "", "kids": [], "up": None, "cls": (), "id": None}

        def handle_starttag(self, tag, attrs, empty=False):
            d = dict(attrs)
            node = {"tag": tag, "kids": [], "up": self.cur, "cls": (d.get("class") or "").split(), "id": d.get("id")}
            self.cur["kids"].append(node)
            if not empty and tag not in H._VOID:
                self.cur = node

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs, True)

        def handle_endtag(self, tag):
            n = self.cur
            while n is not None and n["tag"] != tag:
                n = n["up"]
            if n is not None and n["up"] is not None:
                self.cur = n["up"]

        def handle_data(self, data):
            if self.cur["tag"] not in ("script", "style", "template"):
                self.cur["kids"].append(data)

    tree = Tree()
    tree.feed(html)
    tree.close()

    def walk(n):
        for k in n["kids"]:
            if not isinstance(k, str):
                yield k
                yield from walk(k)

    def strings(n):
        return [x for k in n["kids"] for x in ([k] if isinstance(k, str) else strings(k))]

    def ups(n):
        while n["up"] is not None:
            n = n["up"]
            yield n

    def is_(n, tag, *cls):
        return n["tag"] == tag and all(c in n["cls"] for c in cls)

    def strip(n):
        return "".join(s.strip() for s in strings(n))

    def first(n, test):
        return next((k for k in walk(n) if test(k)), None)

    cells, cards = [], []
    for n in walk(tree.root):
        if is_(n, "div", "cell"):
            d = first(n, lambda k: is_(k, "div", "desc"))
            v = first(n, lambda k: k["tag"] == "span" and any(is_(u, "div", "value") for u in ups(k)))
            if d and H.VP_KEY in strip(d).upper() and v:
                cells.append("".join(strings(v)))
        if is_(n, "div", "_card"):
            h, b = (first(n, lambda k, c=c: is_(k, "div", c)) for c in ("_card-header", "_card-body"))
            if h and "DY" in strip(h).upper() and b:
                cards.append("".join(strings(b)))
    table = first(tree.root, lambda k: k["id"] == H.TABLE_ID)
    rows, text = [], None
    if table:
        for tr in (k for k in walk(table) if k["tag"] == "tr"):
            tds = [k for k in walk(tr) if k["tag"] == "td"]
            rows += [(strip(tds[0]).upper(), strip(tds[1]))] if len(tds) > 1 else []
        m = re.search(H.TEXT_VP_PATTERN, " ".join(s.strip() for s in strings(tree.root) if s.strip()), re.IGNORECASE)
        text = m and m.group(1)
    quote = first(tree.root, lambda k: k["tag"] == "span" and any(
        is_(u, "div", "value") and any(is_(w, "div", "_card", "cotacao") for w in ups(u)) for u in ups(k)))
    return cells[-1:], cards[-1:], rows, table is not None, text, "".join(strings(quote)) if quote else None


def test_flat_reading_equals_a_tree():
    import random

    r = random.Random(4)
    parts = ['<div class="cell">', '<div class="desc x">', '<div class="value">', '<div class="_card cotacao">', '<div class="_card">',
             '<div class="_card-header">', '<div class="_card-body">', "<span>", "</span>", "</div>", "</div>", "<p>", "</p>",
             '<table id="table-indicators">', "<tr>", "<td>", "</td>", "</tr>", "</table>", "<br>", "<br/>", "<script>x</script>",
             "Patrimonial p/ cota", "valor patrimonial ", "p/ cota", "DY (12M)", "Dividend Yield", " R$ 1,50 ", "2,5%", "VPA", "\n", "abc",
             "<b/>", "</x>", "&amp;", "<template>", "</template>", "inf", "R$"]
    for _ in range(4000):
        html = "".join(r.choice(parts) for _ in range(r.randint(1, 60)))
        got, want = H.extract_page(html), by_recursion(html)
        assert (got["cell_vp"], got["card_dy"], got["has_table"], got["text_vp"], got["quote_raw"]) == (*want[:2], *want[3:]), html
        for key in (H.VP_KEY, H.DY_TABLE_KEY):  # rows that may parse, in order
            mine = [v for k, v in zip(got["table_keys"], got["table_vals"]) if key in k]
            assert mine == [v for k, v in want[2] if key in k and not H._OTHER_LETTER.search(v)], html
