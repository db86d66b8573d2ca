"""Column -> Column text functions: three number parsers, Brazilian
formatting, ticker/sector rules (SURVEY 2.2, N1-N10, N14-N23).

All are built-in expressions (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# --------------------------------------------------------------------------
# Keywords that make a sector "brick" (in this order, as in the reference):
BRICK_KEYWORDS = [
    "TIJOLO", "LOGIST", "SHOP", "LAJE", "CORPORAT", "RESID", "HOSPITAL", "HOTEL",
    "EDUC", "AGRO", "IMOBILIARIO URB", "RENDA URB", "DESENV", "MULTIPROPRI",
    "HÍBRID", "HIBRID", "INDUSTR",
]
# Portuguese month names, January first:
MONTHS_PT = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho",
    "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]
# Labels and literals of the screens and of the sheets:
BRICK_LABEL = "Tijolo"
PAPER_LABEL = "Papéis"
DEFAULT_SECTOR = "Indefinido"
MASK = "••••••"
TICKER_PATTERN = r"^[A-Z]{4}11[B]?$"
FUND_LINK_BASE = "https://investidor10.com.br/fiis/"
STOCK_LINK_BASE = "https://investidor10.com.br/acoes/"
# --------------------------------------------------------------------------

_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # Python str.isspace()
_STRIP = rf"^{_WS}+|{_WS}+$"
_D = r"\d+(?:_\d+)*"
# Python float() grammar: optional blanks around, underscores only between
# digits, nan/inf/infinity in any case.
_FLOAT_GRAMMAR = (rf"^{_WS}*[+-]?(?:(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?|(?i:nan|inf|infinity)){_WS}*$")
# Characters Spark's cast does not already ignore at the ends (it trims
# ASCII blanks and control characters): underscores and non-ASCII blanks.
_PLAIN = r"^[0-9]+(?:\.[0-9]+)?\z"  # what nearly every cell holds: the cast alone reads it
_CLEAN_KEY = r"^[A-Z0-9]+\z"  # neither trimmed nor changed to capitals
_NEEDS_CLEANUP = r"[_\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _plain_number(c: Column, *dropped: str) -> Column:
    """``c`` without 'R$' and the characters ``dropped``, then ',' -> '.'. Byte
    searches, which pass over text without a match; ``translate`` would look up
    every character as a string of its own."""
    for x in ("R$", *dropped):
        c = F.replace(c, F.lit(x), F.lit(""))
    return F.replace(c, F.lit(","), F.lit("."))


def _py_float(s: Column) -> Column:
    """Python ``float(s)`` semantics: a double when ``s`` is in Python's
    float grammar, else null. Spark's cast alone would accept '12d'/'12f'.

    Plain digits with a decimal point go straight to the cast. Any other text is
    validated by one ``rlike`` and cast as it is, unless it holds an underscore or a
    non-ASCII blank (then one regex removes them). That rare path is a ``transform``
    over one element, which is not part of the generated row loop: five parses
    in one loop would make a method too large to be compiled to machine code."""
    def rare(x: Column) -> Column:
        core = F.when(x.rlike(_NEEDS_CLEANUP), F.regexp_replace(x, rf"{_STRIP}|(?<=\d)_(?=\d)", "")).otherwise(x)
        signed_nan = F.lower(F.trim(x)).isin("+nan", "-nan")
        return F.when(x.rlike(_FLOAT_GRAMMAR),
                      F.when(signed_nan, F.lit(float("nan"))).otherwise(core.try_cast("double")))

    return F.when(s.rlike(_PLAIN), s.try_cast("double")).otherwise(F.get(F.transform(F.array(s), rare), F.lit(0)))


def to_number(c: Column) -> Column:
    """Numeric text -> double with Python's float grammar, else null."""
    return _py_float(c)


def parse_or_zero(c: Column) -> Column:
    """N1 (dashboard parser): drop 'R$', '%', every U+0020 and every '.',
    then ',' -> '.'; failure or null -> 0.0. '8.50' becomes 850.0."""
    s = _plain_number(c, "%", " ", ".")
    return F.coalesce(_py_float(s), F.lit(0.0))


def parse_or_null(c: Column) -> Column:
    """N3 (indicator parser): null/'' -> null; drop 'R$', '%', strip ends,
    drop '.', ',' -> '.'; failure -> null (inner blanks fail)."""
    s = _plain_number(c, "%", ".")
    return F.when(c != "", _py_float(s))


def parse_quote(c: Column) -> Column:
    """N4 (quote parser): drop 'R$' and '.', ',' -> '.', strip; failure -> 0.0."""
    s = _plain_number(c, ".")
    return F.coalesce(_py_float(s), F.lit(0.0))


def parse_strict(c: Column) -> Column:
    """N2 (report parser): drop 'R$' and '.', ',' -> '.', strip ends;
    anything else ('%', inner blanks, empty) raises and aborts the read."""
    s = _plain_number(c, ".")
    v = _py_float(s)
    return F.when(v.isNotNull(), v).otherwise(
        F.raise_error(F.concat(F.lit("could not convert string to float: "), F.coalesce(c, F.lit("None")))).cast("double")
    )


_PRE = {
    # parser kind -> text clean-up before the float grammar (no regex)
    "zero": lambda c: _plain_number(c, "%", " ", "."),
    "null": lambda c: _plain_number(c, "%", "."),
    "quote": lambda c: _plain_number(c, "."),
}


def _sql_lit(s: str) -> str:
    """A Spark SQL string literal holding exactly ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _py_float_sql(name: str) -> Column:
    """``_py_float`` of the column ``name`` as one SQL expression (built in
    a single call to the JVM instead of one per operator)."""
    c = f"`{name}`"
    rare = (f"CASE WHEN x RLIKE {_sql_lit(_FLOAT_GRAMMAR)} THEN "
            f"CASE WHEN lower(trim(x)) IN ('+nan', '-nan') THEN CAST('NaN' AS DOUBLE) "
            f"ELSE try_cast(CASE WHEN x RLIKE {_sql_lit(_NEEDS_CLEANUP)} "
            f"THEN regexp_replace(x, {_sql_lit(_STRIP + '|(?<=' + chr(92) + 'd)_(?=' + chr(92) + 'd)')}, '') "
            f"ELSE x END AS DOUBLE) END END")
    return F.expr(f"CASE WHEN {c} RLIKE {_sql_lit(_PLAIN)} THEN try_cast({c} AS DOUBLE) "
                  f"ELSE get(transform(array({c}), x -> {rare}), 0) END")


def with_parsed(df: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Parse several text columns: ``specs`` maps an output name to (kind,
    input column), kind in 'zero' (N1), 'null' (N3), 'quote' (N4). The
    cleaned text is a column of its own that the parse reads, so the
    clean-up runs once per value (the optimizer keeps the projections apart
    rather than duplicate an expensive expression)."""
    pre = {f"_pre_{o}": _PRE[k](F.col(i)) for o, (k, i) in specs.items()}
    staged = df.withColumns(pre)
    out = {}
    for o, (k, i) in specs.items():
        v = _py_float_sql(f"_pre_{o}")
        out[o] = F.when(F.col(i) != "", v) if k == "null" else F.coalesce(v, F.lit(0.0))
    return staged.withColumns(out).drop(*pre)


def _grouped_2dp(x: Column) -> Column:
    """'1,234,567.90' style text of a finite double, Python rounding."""
    return F.format_number(x, 2)


def _special_text(x: Column) -> Column:
    return (F.when(F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf"))
            .when(x == float("-inf"), F.lit("-inf")))


def fmt_currency(x: Column) -> Column:
    """N5: 'R$ 1.234,56' (thousands '.', decimal ','); null stays null."""
    body = F.translate(_grouped_2dp(x), ",.", ".,")
    return F.when(x.isNotNull(), F.concat(F.lit("R$ "), F.coalesce(_special_text(x), body)))


def fmt_percent(x: Column) -> Column:
    """x*100 with 2 decimals, ',' decimal, no thousands separator."""
    body = F.translate(F.regexp_replace(_grouped_2dp(x * 100), ",", ""), ".", ",")
    return F.when(x.isNotNull(), F.concat(F.coalesce(_special_text(x * 100), body), F.lit("%")))


def py_number(x: Column) -> Column:
    """A double as Python's ``repr`` and CSV writer give it: the fewest digits
    that read back as the same double, with an exponent from 1e16 on and below
    1e-4. Spark's text has further digits for some doubles, and none of its
    expressions tells which are superfluous, so an Arrow batch at a time goes
    through Python: use it on the few rows of a report."""
    @F.pandas_udf("string")
    def text(values):
        return values.map(repr)

    return F.when(x.isNotNull(), text(x))


def masked(formatted: Column, privacy: bool | Column) -> Column:
    """Every formatted amount becomes the mask in privacy mode."""
    p = privacy if isinstance(privacy, Column) else F.lit(bool(privacy))
    return F.when(p, F.lit(MASK)).otherwise(formatted)


def clean_key(c: Column) -> Column:
    """Trim + upper (Python ``str.strip().upper()``). Text of A-Z and digits
    alone, as nearly every key is, is its own key: one test instead of both."""
    return F.when(c.rlike(_CLEAN_KEY), c).otherwise(F.upper(strip_py(c)))


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name`` computed once a row, before any filter that
    reads it. A filter over a projection is moved below it and takes the whole
    expression along, so that an expensive one is evaluated again for each test;
    it is not moved below the generator of a one-element array."""
    return df.withColumn(name, F.explode(F.array(name)))


# Every character Python's str.isspace() accepts, as one literal string.
_WS_CHARS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def strip_py(c: Column) -> Column:
    """Python ``str.strip()`` (all Unicode blanks). Spark's ``trim`` removes
    ASCII spaces only, so the regex runs only when an end character is
    some other blank; the usual value takes the cheap path."""
    t = F.trim(c)
    odd_end = (F.length(t) > 0) & ((F.instr(F.lit(_WS_CHARS), F.substring(t, 1, 1)) > 0)
                                   | (F.instr(F.lit(_WS_CHARS), F.substring(t, -1, 1)) > 0))
    return F.when(odd_end, F.regexp_replace(c, _STRIP, "")).otherwise(t)


def is_valid_ticker(c: Column) -> Column:
    """Fund ticker rule, on an already trimmed/upper-cased key."""
    return c.rlike(TICKER_PATTERN)


def _accent_table() -> tuple[str, str]:
    """Single-character accent folding derived by rule from Unicode NFD
    over the Latin blocks (no hand-written table)."""
    src, dst = [], []
    ranges = [(0x00C0, 0x0250), (0x1E00, 0x1F00)]
    for lo, hi in ranges:
        for cp in range(lo, hi):
            ch = chr(cp)
            base = "".join(b for b in unicodedata.normalize("NFD", ch)
                           if unicodedata.category(b) != "Mn")
            if base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


_ACCENT_SRC, _ACCENT_DST = _accent_table()
# Combining marks (category Mn) of the Basic Multilingual Plane, by rule:
# they are deleted, which covers text that arrives already decomposed.
_MARKS = "".join(chr(i) for i in range(0x10000) if unicodedata.category(chr(i)) == "Mn")


def normalize_sector(c: Column) -> Column:
    """NFD, drop combining marks, upper, strip; null/'' -> ''.

    One ``translate`` folds precomposed letters to their base letter and
    deletes combining marks (characters beyond the replacement string are
    removed), so no regex runs per row."""
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(strip_py(_folded_upper(c)))


def _folded_upper(c: Column) -> Column:
    return F.upper(F.translate(c, _ACCENT_SRC + _MARKS, _ACCENT_DST))


def is_brick(sector: Column) -> Column:
    """Normalised sector contains any brick keyword (non-null boolean)."""
    # One alternation over the literal keywords (none holds a regex
    # metacharacter, none begins or ends with a blank): the text is folded once
    # per row, and the blanks that normalising strips can't decide.
    return F.coalesce(_folded_upper(sector).rlike("|".join(BRICK_KEYWORDS)), F.lit(False))


def segment(sector: Column) -> Column:
    """P8: 'Tijolo' for brick sectors, else 'Papéis' (for every asset type)."""
    return F.when(is_brick(sector), F.lit(BRICK_LABEL)).otherwise(F.lit(PAPER_LABEL))


def scale_dy(x: Column) -> Column:
    """A parsed DY above 2.0 is a percentage; 2.0 and below stay."""
    return F.when(x > 2.0, x / 100).otherwise(x)


def sector_or_default(c: Column) -> Column:
    """Blank or 'nan' (any case) -> 'Indefinido'; else stripped text."""
    s = strip_py(c)
    return F.when(s.isNull() | (s == "") | (F.lower(s) == "nan"), F.lit(DEFAULT_SECTOR)).otherwise(s)


def asset_link(ticker: Column, asset_type: Column) -> Column:
    """Detail link per type; none for 'Outros'."""
    low = F.lower(ticker)
    return (F.when(asset_type == "FII", F.concat(F.lit(FUND_LINK_BASE), low, F.lit("/")))
            .when(asset_type == "Ação", F.concat(F.lit(STOCK_LINK_BASE), low, F.lit("/"))))


def month_label(d: Column) -> Column:
    """N14: 'Junho / 2024'."""
    names = F.array(*[F.lit(m) for m in MONTHS_PT])
    return F.concat(F.element_at(names, F.month(d)), F.lit(" / "), F.year(d).cast("string"))


def quote_symbol(ticker: Column) -> Column:
    """Market symbol, '.SA' appended unless present."""
    return F.when(ticker.endswith(".SA"), ticker).otherwise(F.concat(ticker, F.lit(".SA")))


def series_name(symbol: Column, evolution: bool = False) -> Column:
    """Symbol back to a series name: '^BVSP' -> IBOVESPA (history tab) or
    Ibovespa (evolution chart); 'IFIX.SA' -> IFIX; else '.SA' removed."""
    bvsp = "Ibovespa" if evolution else "IBOVESPA"
    return (F.when(symbol == "^BVSP", F.lit(bvsp))
            .when(symbol == "IFIX.SA", F.lit("IFIX"))
            .otherwise(F.replace(symbol, F.lit(".SA"), F.lit(""))))


def strip_fences(c: Column) -> Column:
    """Remove ```html and ``` fences from generated text."""
    return F.replace(F.replace(c, F.lit("```html"), F.lit("")), F.lit("```"), F.lit(""))


def sign_class(x: Column) -> Column:
    """N22: 'pos' when x >= 0 else 'neg'."""
    return F.when(x >= 0, F.lit("pos")).otherwise(F.lit("neg"))


def sign_prefix(x: Column) -> Column:
    return F.when(x >= 0, F.lit("+")).otherwise(F.lit(""))


def rate_delta_label(used: Column, official: Column) -> tuple[Column, Column]:
    """Label and class of the used-vs-official rate difference."""
    d = used - official
    neutral = F.abs(d) < 1e-6
    text = F.when(neutral, F.lit("Oficial")).otherwise(
        F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), fmt_percent(d), F.lit(" vs oficial")))
    cls = F.when(neutral, F.lit("neu")).when(d > 0, F.lit("pos")).otherwise(F.lit("neg"))
    return text, cls
