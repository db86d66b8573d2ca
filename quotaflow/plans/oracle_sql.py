"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: the fixture numbers are computed
directly (no text round trip), keep-first uses QUALIFY, segments use
``strip_accents``, business days are counted on a generated calendar, the
portfolio series is the dense grid, and so on. Money is rounded to 4 places
and ratios to 6 on both sides before comparison.
"""

from __future__ import annotations

from quotaflow.functions.text import BRICK_KEYWORDS
from quotaflow.sources.fixtures import SECTOR_BY_TYPE

REF_DATE = "DATE '2024-06-15'"

_SECTOR_CASE = "CASE split_part(p.p_type, ' ', 1) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in SECTOR_BY_TYPE.items()) + " END"
_BRICK_RE = "|".join(BRICK_KEYWORDS)


def _ticker(k: str) -> str:
    return (f"chr(CAST(65 + ({k} // 17576) % 26 AS INTEGER)) || chr(CAST(65 + ({k} // 676) % 26 AS INTEGER)) || "
            f"chr(CAST(65 + ({k} // 26) % 26 AS INTEGER)) || chr(CAST(65 + {k} % 26 AS INTEGER)) || '11'")


# Fixture holdings, numeric (FIXTURES.md 2.1).
FIXTURE = f"""
hold AS (
  SELECT o.o_custkey AS portfolio_id, l.l_partkey % 456976 AS k, sum(l.l_quantity) AS qty
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2),
pstat AS (
  SELECT l_partkey % 456976 AS k, round(sum(l_extendedprice) / sum(l_quantity), 2) AS mkt_price,
         (200 * (sum(CAST(round(l_discount * 100) AS BIGINT)) + sum(CAST(round(l_tax * 100) AS BIGINT))) + count(*))
           // (2 * count(*)) AS dy_hund
  FROM lineitem GROUP BY 1),
fx AS (
  SELECT h.portfolio_id, h.k, h.qty, s.mkt_price, s.dy_hund,
    {_ticker('h.k')} AS ticker,
    CASE WHEN h.k % 10 < 7 THEN 'FII' WHEN h.k % 10 < 9 THEN 'Ação' ELSE 'Outros' END AS asset_type,
    CASE WHEN h.k % 31 = 0 THEN 'Indefinido' ELSE {_SECTOR_CASE} END AS fund_sector,
    round(p.p_retailprice * 2.0, 2) AS cost,
    CASE WHEN h.k % 23 <> 0 THEN round(p.p_retailprice * 2.2, 2) ELSE 0.0 END AS book,
    DATE '2024-06-01' + CAST(h.k % 90 AS INTEGER) AS exd,
    CASE h.k % 6 WHEN 0 THEN strftime(DATE '2024-06-01' + CAST(h.k % 90 AS INTEGER), '%d/%m/%Y')
                 WHEN 1 THEN strftime(DATE '2024-06-01' + CAST(h.k % 90 AS INTEGER), '%d/%m')
                 WHEN 2 THEN CAST(h.k % 22 + 1 AS VARCHAR) || 'º DIA ÚTIL'
                 WHEN 3 THEN 'ÚLTIMO DIA ÚTIL'
                 WHEN 4 THEN '-'
                 ELSE strftime(DATE '2024-06-01' + CAST(h.k % 90 AS INTEGER), '%d/%m/%y') END AS ex_date_text
  FROM hold h JOIN pstat s ON s.k = h.k JOIN (
    SELECT DISTINCT ON (p_partkey % 456976) * FROM part ORDER BY p_partkey) p ON p.p_partkey % 456976 = h.k)"""

FUND_ROWS = """
fund AS (
  SELECT portfolio_id, 0 AS source_rank, CAST(k AS BIGINT) AS row_idx, ticker, 'FII' AS asset_type,
         fund_sector AS sector, qty AS quantity, cost AS avg_cost, mkt_price AS price, book AS book_value,
         CASE WHEN CAST(dy_hund AS DOUBLE) / 100 > 2 THEN CAST(dy_hund AS DOUBLE) / 100 / 100
              ELSE CAST(dy_hund AS DOUBLE) / 100 END AS dy_12m,
         ex_date_text, 'https://investidor10.com.br/fiis/' || lower(ticker) || '/' AS link
  FROM fx WHERE asset_type = 'FII'
  UNION ALL
  SELECT portfolio_id, 0, CAST(k + 1000000000 AS BIGINT), ticker, 'FII', fund_sector, qty, cost,
         CAST(CAST(mkt_price + 1 AS DECIMAL(18,2)) AS DOUBLE), book,
         CASE WHEN CAST(dy_hund AS DOUBLE) / 100 > 2 THEN CAST(dy_hund AS DOUBLE) / 100 / 100
              ELSE CAST(dy_hund AS DOUBLE) / 100 END,
         ex_date_text, 'https://investidor10.com.br/fiis/' || lower(ticker) || '/'
  FROM fx WHERE asset_type = 'FII' AND k % 17 = 0)"""

MANUAL_ROWS = """
manual AS (
  SELECT portfolio_id, 1 AS source_rank, CAST(k AS BIGINT) AS row_idx, ticker, asset_type,
         CASE WHEN asset_type = 'Ação' THEN 'Ações' ELSE 'Ação/Outros' END AS sector,
         CASE WHEN asset_type = 'Ação' THEN qty ELSE 1.0 END AS quantity,
         CASE WHEN asset_type = 'Ação' THEN cost ELSE 0.0 END AS avg_cost,
         CASE WHEN asset_type = 'Outros' THEN mkt_price
              WHEN k % 4 <> 0 AND mkt_price > 0 THEN mkt_price ELSE cost END AS price,
         0.0 AS book_value, 0.0 AS dy_12m, '-' AS ex_date_text,
         CASE WHEN asset_type = 'Ação' THEN 'https://investidor10.com.br/acoes/' || lower(ticker) || '/' END AS link
  FROM fx WHERE asset_type <> 'FII')"""

POSITIONS = f"""
uni AS (SELECT * FROM fund UNION ALL SELECT * FROM manual),
dedup AS (
  SELECT * FROM uni
  QUALIFY row_number() OVER (PARTITION BY portfolio_id, ticker, asset_type ORDER BY source_rank, row_idx) = 1),
val AS (
  SELECT *, CASE WHEN asset_type IN ('FII', 'Ação') THEN quantity * price ELSE price END AS market_value,
         CASE WHEN asset_type IN ('FII', 'Ação') AND avg_cost > 0 THEN quantity * avg_cost
              WHEN asset_type IN ('FII', 'Ação') THEN quantity * price ELSE price END AS invested
  FROM dedup),
pos AS (
  SELECT *, market_value - invested AS profit,
         CASE WHEN asset_type = 'FII' THEN market_value * dy_12m / 12 ELSE 0.0 END AS monthly_income,
         CASE WHEN book_value > 0 THEN price / book_value ELSE 0.0 END AS price_to_book,
         CASE WHEN invested > 0 THEN market_value / invested - 1 ELSE 0.0 END AS return_pct,
         CASE WHEN sum(market_value) OVER (PARTITION BY portfolio_id) > 0
              THEN market_value / sum(market_value) OVER (PARTITION BY portfolio_id) ELSE 0.0 END AS weight,
         CASE WHEN regexp_matches(upper(strip_accents(sector)), '{_BRICK_RE}') THEN 'Tijolo' ELSE 'Papéis' END AS segment
  FROM val),
means AS (
  SELECT portfolio_id, CAST(CAST(sum(CAST(CAST(market_value AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE) AS total_value,
         count(*) AS n_positions, avg(weight) AS mean_weight, avg(dy_12m) AS mean_dy
  FROM pos GROUP BY 1)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BASE = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS, POSITIONS)

POSITION_COLS = ("portfolio_id, source_rank, row_idx, ticker, asset_type, sector, round(quantity, 4) AS quantity, "
                 "round(avg_cost, 4) AS avg_cost, round(price, 4) AS price, round(book_value, 4) AS book_value, "
                 "round(dy_12m, 6) AS dy_12m, ex_date_text, link")


ORACLE: dict[str, str] = {}

ORACLE["fund_positions"] = with_ctes(FIXTURE, FUND_ROWS) + f"\nSELECT {POSITION_COLS} FROM fund"

ORACLE["manual_positions"] = with_ctes(FIXTURE) + """
SELECT portfolio_id, 1 AS source_rank, CAST(k AS BIGINT) AS row_idx, ticker, asset_type,
       CASE WHEN asset_type = 'Ação' THEN 'Ações' ELSE 'Ação/Outros' END AS sector,
       round(CASE WHEN asset_type = 'Ação' THEN qty ELSE 1.0 END, 4) AS quantity,
       round(CASE WHEN asset_type = 'Ação' THEN cost ELSE 0.0 END, 4) AS avg_cost,
       round(CASE WHEN asset_type = 'Ação' THEN cost ELSE mkt_price END, 4) AS price,
       CAST(0.0 AS DOUBLE) AS book_value, CAST(0.0 AS DOUBLE) AS dy_12m, '-' AS ex_date_text,
       CASE WHEN asset_type = 'Ação' THEN 'https://investidor10.com.br/acoes/' || lower(ticker) || '/' END AS link
FROM fx WHERE asset_type <> 'FII'"""

ORACLE["quote_enrich"] = with_ctes(FIXTURE, MANUAL_ROWS) + """
SELECT portfolio_id, ticker, asset_type, round(price, 4) AS price FROM manual"""

ORACLE["union_positions"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS) + f"""
SELECT {POSITION_COLS} FROM (SELECT * FROM fund UNION ALL SELECT * FROM manual)"""

ORACLE["dedup_first"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS) + f"""
SELECT DISTINCT ON (portfolio_id, ticker, asset_type) {POSITION_COLS}
FROM (SELECT * FROM fund UNION ALL SELECT * FROM manual)
ORDER BY portfolio_id, ticker, asset_type, source_rank, row_idx"""

ORACLE["valuation"] = BASE + """
SELECT portfolio_id, ticker, asset_type, round(market_value, 4) AS market_value, round(invested, 4) AS invested,
       round(profit, 4) AS profit, round(monthly_income, 4) AS monthly_income,
       round(price_to_book, 6) AS price_to_book, round(return_pct, 6) AS return_pct
FROM pos"""

ORACLE["weights"] = BASE + """
SELECT portfolio_id, ticker, asset_type, round(market_value, 4) AS market_value, round(weight, 6) AS weight FROM pos"""

ORACLE["segment"] = BASE + "\nSELECT portfolio_id, ticker, asset_type, sector, segment FROM pos"

ORACLE["opportunities"] = BASE + """
, opp AS (
  SELECT p.*, m.total_value, m.mean_weight,
         greatest(0.0, m.total_value / m.n_positions - p.market_value) AS suggested_contribution
  FROM pos p JOIN means m USING (portfolio_id)
  WHERE p.asset_type = 'FII' AND p.price_to_book BETWEEN 0.8 AND 0.99 AND p.dy_12m >= 0.09
    AND p.weight < m.mean_weight),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY price_to_book, dy_12m DESC,
                               suggested_contribution DESC, source_rank, row_idx) AS rank
  FROM opp WHERE suggested_contribution >= 1000)
SELECT portfolio_id, CAST(rank AS INTEGER) AS rank, ticker, sector, segment, round(price, 4) AS price,
       round(price_to_book, 6) AS price_to_book, round(dy_12m, 6) AS dy_12m, round(weight, 6) AS weight,
       round(market_value, 4) AS market_value, round(suggested_contribution, 2) AS suggested_contribution, link
FROM ranked WHERE rank <= 4"""

RISK = """
, risk AS (
  SELECT p.*, 
    p.price_to_book > 1.1 AS r_exp,
    p.dy_12m < greatest(m.mean_dy * 0.85, 0.12 * CASE WHEN p.segment = 'Tijolo' THEN 0.6 ELSE 0.8 END) AS r_low,
    p.price_to_book < 0.7 AND p.dy_12m < 0.08 AS r_trap
  FROM pos p JOIN means m USING (portfolio_id) WHERE p.asset_type = 'FII'),
risk2 AS (
  SELECT *,
    CASE WHEN NOT (r_exp OR r_low OR r_trap) THEN 'Observação'
         ELSE concat_ws(' + ', CASE WHEN r_exp THEN 'Caro' END, CASE WHEN r_low THEN 'Baixo Yield' END,
                        CASE WHEN r_trap THEN 'Armadilha' END) END AS risk_reasons,
    CAST(CASE WHEN NOT (r_exp OR r_low OR r_trap) THEN 99 WHEN r_low AND r_trap THEN 0 WHEN r_low THEN 1
              WHEN r_exp THEN 2 ELSE 3 END AS INTEGER) AS risk_rank
  FROM risk),
risk3 AS (
  SELECT *, CASE risk_rank WHEN 99 THEN 'Observação' WHEN 0 THEN 'Baixo Yield + Armadilha'
                 WHEN 1 THEN 'Baixo Yield' WHEN 2 THEN 'Caro' ELSE risk_reasons END AS risk_label
  FROM risk2)"""

ORACLE["risk_classify"] = BASE + RISK + """
SELECT portfolio_id, ticker, round(price_to_book, 6) AS price_to_book, round(dy_12m, 6) AS dy_12m,
       risk_reasons, risk_rank, risk_label FROM risk3"""

ORACLE["risk_radar"] = BASE + RISK + """
, radar AS (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY risk_rank, market_value DESC, source_rank, row_idx) AS rank
  FROM risk3 WHERE risk_reasons <> 'Observação')
SELECT portfolio_id, CAST(rank AS INTEGER) AS rank, ticker, round(market_value, 4) AS market_value, risk_rank,
       risk_label, risk_reasons
FROM radar WHERE rank <= 4"""

ORACLE["value_matrix"] = BASE + """
, f AS (SELECT * FROM pos WHERE asset_type = 'FII' AND price_to_book > 0),
mx AS (SELECT portfolio_id, max(dy_12m) AS max_dy FROM f GROUP BY 1)
SELECT f.portfolio_id, f.ticker, round(f.price_to_book, 6) AS price_to_book, round(f.dy_12m, 6) AS dy_12m,
       round(f.market_value, 4) AS market_value,
       (f.price_to_book BETWEEN 0 AND 1.0 AND f.dy_12m >= m.mean_dy AND f.dy_12m <= mx.max_dy * 1.1) AS in_value_box
FROM f JOIN means m USING (portfolio_id) JOIN mx USING (portfolio_id)"""

ORACLE["best_discounts"] = BASE + """
SELECT portfolio_id, ticker, round(price, 4) AS price, round(price_to_book, 6) AS price_to_book,
       round(dy_12m, 6) AS dy_12m, round(market_value, 4) AS market_value, round(weight, 6) AS weight
FROM pos WHERE asset_type = 'FII' AND price_to_book > 0.1 AND price_to_book < 1.0
ORDER BY portfolio_id, price_to_book, ticker"""

ORACLE["inventory"] = BASE + """
SELECT portfolio_id, link AS detail_link, ticker, segment, sector, round(avg_cost, 4) AS avg_cost,
       round(price, 4) AS price, round(quantity, 4) AS quantity, round(market_value, 4) AS market_value,
       round(return_pct, 6) AS return_pct, round(dy_12m, 6) AS dy_12m, round(weight, 6) AS weight,
       round(monthly_income, 4) AS monthly_income
FROM pos"""

ORACLE["top15"] = BASE + """
, t AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY market_value DESC, ticker) AS rank FROM pos)
SELECT portfolio_id, CAST(rank AS INTEGER) AS rank, ticker, asset_type, round(price, 4) AS price,
       round(price_to_book, 6) AS price_to_book, round(dy_12m, 6) AS dy_12m, round(market_value, 4) AS market_value
FROM t WHERE rank <= 15"""

ORACLE["sector_exposure"] = BASE + """
SELECT portfolio_id, sector, round(sum(market_value), 4) AS sector_value FROM pos GROUP BY 1, 2"""

ORACLE["hierarchy_rollup"] = BASE + """
SELECT portfolio_id,
       CAST(CASE WHEN ticker IS NOT NULL THEN 3 WHEN sector IS NOT NULL THEN 2
                 WHEN asset_type IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS level,
       asset_type, sector, ticker, round(node_value, 4) AS node_value, n_positions
FROM (
  SELECT portfolio_id, asset_type, sector, ticker, sum(market_value) AS node_value, count(*) AS n_positions
  FROM pos GROUP BY GROUPING SETS ((portfolio_id, asset_type, sector, ticker), (portfolio_id, asset_type, sector),
                                   (portfolio_id, asset_type), (portfolio_id)))"""

# ------------------------------------------------------------------- agenda
# Ex-dates are known from the fixture key k (row_idx of a fund row) without
# parsing text; business days are counted on a generated calendar.
AGENDA = """
, bd AS (
  SELECT CAST(d AS DATE) AS d, row_number() OVER (ORDER BY d) AS n
  FROM range(TIMESTAMP '2024-06-01', TIMESTAMP '2024-10-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5),
ag0 AS (
  SELECT portfolio_id, ticker, ex_date_text, link AS detail_link, monthly_income AS est_dividend, row_idx AS k,
         DATE '2024-06-01' + CAST(row_idx % 90 AS INTEGER) AS d0
  FROM pos WHERE asset_type = 'FII' AND ex_date_text <> '-'),
ag1 AS (
  SELECT *, CASE k % 6 WHEN 0 THEN d0 WHEN 5 THEN d0
      WHEN 1 THEN CASE WHEN d0 < DATE '2024-06-15' THEN CAST(d0 + INTERVAL 1 YEAR AS DATE) ELSE d0 END
      WHEN 2 THEN (SELECT bd.d FROM bd WHERE bd.n = CASE WHEN isodow(DATE '2024-06-01') > 5
                                                      THEN greatest(ag0.k % 22, 1) ELSE ag0.k % 22 + 1 END)
      WHEN 3 THEN (SELECT max(bd.d) FROM bd WHERE month(bd.d) = 6) END AS ex_date
  FROM ag0),
agm AS (
  SELECT portfolio_id, ticker, ex_date_text, ex_date, detail_link, est_dividend,
         CASE WHEN ex_date <= DATE '2024-06-15' THEN 'Já ocorreu' ELSE 'Próxima' END AS status,
         CAST(date_trunc('month', ex_date) AS DATE) AS month
  FROM ag1 WHERE ex_date IS NOT NULL),
chosen AS (
  SELECT portfolio_id, coalesce(max(month) FILTER (WHERE month = DATE '2024-06-01'), min(month)) AS chosen_month
  FROM agm GROUP BY 1),
sl AS (SELECT a.* FROM agm a JOIN chosen c ON a.portfolio_id = c.portfolio_id AND a.month = c.chosen_month)"""

ORACLE["agenda"] = BASE + AGENDA + """
SELECT portfolio_id, ticker, ex_date_text, ex_date, status, month, round(est_dividend, 4) AS est_dividend,
       detail_link FROM agm"""

ORACLE["agenda_default_month"] = BASE + AGENDA + """
, dm AS (SELECT DISTINCT portfolio_id, month FROM agm),
ml AS (SELECT portfolio_id, count(*) AS n_months, string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) AS months
       FROM dm GROUP BY 1)
SELECT c.portfolio_id, c.chosen_month, CAST(ml.n_months AS INTEGER) AS n_months, ml.months
FROM chosen c JOIN ml USING (portfolio_id)"""

ORACLE["agenda_month"] = BASE + AGENDA + """
SELECT portfolio_id, ticker, ex_date_text, ex_date, status, round(est_dividend, 4) AS est_dividend, detail_link
FROM sl ORDER BY portfolio_id, ex_date, ticker"""

ORACLE["agenda_metrics"] = BASE + AGENDA + """
, mt AS (
  SELECT a.portfolio_id, c.chosen_month, CAST(CAST(sum(CAST(CAST(a.est_dividend AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE) AS month_total,
         coalesce(CAST(CAST(sum(CAST(CAST(a.est_dividend AS VARCHAR) AS DECIMAL(38, 18))) FILTER (WHERE c.chosen_month = DATE '2024-06-01'
                                              AND a.ex_date <= DATE '2024-06-15') AS VARCHAR) AS DOUBLE), 0.0) AS passed
  FROM sl a JOIN chosen c USING (portfolio_id) GROUP BY 1, 2)
SELECT portfolio_id, chosen_month, round(month_total, 4) AS month_total, round(passed, 4) AS passed,
       round(greatest(month_total - passed, 0.0), 4) AS pending FROM mt"""

ORACLE["agenda_metrics_past_month"] = BASE + AGENDA + """
SELECT portfolio_id, DATE '2024-07-01' AS chosen_month, round(CAST(CAST(sum(CAST(CAST(est_dividend AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE), 4) AS month_total,
       CAST(0.0 AS DOUBLE) AS passed, round(greatest(CAST(CAST(sum(CAST(CAST(est_dividend AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE), 0.0), 4) AS pending
FROM agm WHERE month = DATE '2024-07-01' GROUP BY 1"""

ORACLE["agenda_by_date"] = BASE + AGENDA + """
SELECT portfolio_id, ex_date, round(CAST(CAST(sum(CAST(CAST(est_dividend AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE), 4) AS total
FROM sl GROUP BY 1, 2 ORDER BY 1, 2"""

ORACLE["agenda_by_ticker"] = BASE + AGENDA + """
SELECT portfolio_id, ticker, round(CAST(CAST(sum(CAST(CAST(est_dividend AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE), 4) AS total
FROM sl GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2"""

_WD = ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]
ORACLE["dividend_calendar"] = BASE + AGENDA + """
, tot AS (SELECT portfolio_id, ex_date AS day, CAST(CAST(sum(CAST(CAST(est_dividend AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE) AS total
        FROM sl GROUP BY 1, 2),
days AS (
  SELECT portfolio_id, chosen_month, chosen_month + CAST(i AS INTEGER) AS day
  FROM (SELECT portfolio_id, chosen_month, unnest(range(0, CAST(day(last_day(chosen_month)) AS BIGINT))) AS i
        FROM chosen)),
cells AS (
  SELECT d.portfolio_id, d.chosen_month, CAST((day(d.day) - 1 + isodow(d.chosen_month) - 1) // 7 + 1 AS INTEGER) AS week,
         isodow(d.day) - 1 AS wd,
         CASE WHEN t.total > 0 THEN t.total ELSE 0.0 END AS value,
         CASE WHEN t.total > 0 THEN CAST(day(d.day) AS VARCHAR) || chr(10) || 'R$ ' || translate(format('{:,.2f}', t.total), ',.', '.,')
              ELSE CAST(day(d.day) AS VARCHAR) END AS text
  FROM days d LEFT JOIN tot t ON t.portfolio_id = d.portfolio_id AND t.day = d.day)
SELECT portfolio_id, chosen_month, week, """ + ", ".join(
    f"round(max(CASE WHEN wd = {i} THEN value END), 4) AS \"{n}_value\", "
    f"coalesce(max(CASE WHEN wd = {i} THEN text END), '') AS \"{n}_text\"" for i, n in enumerate(_WD)) + """
FROM cells GROUP BY 1, 2, 3"""

# ------------------------------------------------------------------- series
# Dense forms throughout: the ticker x date grid, forward/backward filled with
# IGNORE NULLS windows; the CDI as-of step is DuckDB's ASOF JOIN.
_UT = _ticker("user_id")
SMALL = f"""
WITH ev AS (SELECT CAST(ts AS DATE) AS date, user_id % 456976 AS user_id, event_type, value FROM events),
panel AS (
  SELECT date, {_UT} || '.SA' AS symbol, floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 100.0 AS close FROM ev GROUP BY date, user_id
  UNION ALL SELECT date, '^BVSP', floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 100.0 FROM ev WHERE event_type = 'view' GROUP BY date
  UNION ALL SELECT CAST(date - CAST(day(date) % 2 AS INTEGER) AS DATE), 'IFIX.SA', floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 100.0 FROM ev WHERE event_type = 'click' GROUP BY 1),
p AS (SELECT * FROM panel WHERE date BETWEEN DATE '2023-12-15' AND DATE '2024-06-15'),
hold AS (
  SELECT user_id // 30 AS portfolio_id, user_id AS row_idx, {_UT} AS ticker, {_UT} || '.SA' AS symbol,
         CASE WHEN user_id % 3 > 0 THEN 'FII' ELSE 'Ação' END AS asset_type, CAST(1 + user_id % 7 AS DOUBLE) AS quantity
  FROM (SELECT DISTINCT user_id FROM ev)),
own AS (SELECT DISTINCT h.portfolio_id, p.date FROM hold h JOIN p USING (symbol)),
axis AS (
  SELECT * FROM own UNION
  SELECT o.portfolio_id, b.date FROM (SELECT DISTINCT portfolio_id FROM own) o,
         (SELECT DISTINCT date FROM p WHERE symbol IN ('^BVSP', 'IFIX.SA')) b),
grid AS (
  SELECT h.portfolio_id, h.ticker, h.symbol, h.quantity, a.date FROM hold h JOIN axis a USING (portfolio_id)
  WHERE h.symbol IN (SELECT symbol FROM p)),
filled AS (
  SELECT g.portfolio_id, g.ticker, g.quantity, g.date,
         coalesce(last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.portfolio_id, g.ticker ORDER BY g.date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value(p.close IGNORE NULLS) OVER (PARTITION BY g.portfolio_id, g.ticker ORDER BY g.date
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
  FROM grid g LEFT JOIN p ON p.symbol = g.symbol AND p.date = g.date),
carteira AS (SELECT portfolio_id, date, coalesce(sum(quantity * close), 0.0) AS value FROM filled GROUP BY 1, 2),
bnames AS (SELECT * FROM (VALUES ('^BVSP', 'Ibovespa'), ('IFIX.SA', 'IFIX')) t(symbol, series)),
bench AS (
  SELECT portfolio_id, series, date, value FROM (
    SELECT c.portfolio_id, n.series, c.date,
           last_value(p.close IGNORE NULLS) OVER (PARTITION BY c.portfolio_id, n.series ORDER BY c.date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM carteira c CROSS JOIN bnames n LEFT JOIN p ON p.symbol = n.symbol AND p.date = c.date)
  WHERE value IS NOT NULL),
rates AS (
  SELECT date AS rate_date, floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 100000.0 / 100 AS rate
  FROM ev WHERE event_type = 'signup' AND day(date) % 11 <> 0 GROUP BY 1),
idx AS (
  SELECT rate_date, product(1 + rate) OVER (ORDER BY rate_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_index
  FROM rates),
cdi AS (
  SELECT c.portfolio_id, 'CDI' AS series, c.date, i.cum_index AS value
  FROM carteira c ASOF JOIN idx i ON c.date >= i.rate_date),
longs AS (
  SELECT portfolio_id, 'Carteira' AS series, date, value FROM carteira
  UNION ALL SELECT * FROM bench UNION ALL SELECT * FROM cdi),
rb AS (
  SELECT c.portfolio_id, s.series, c.date,
         last_value(l.value IGNORE NULLS) OVER (PARTITION BY c.portfolio_id, s.series ORDER BY c.date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
  FROM carteira c JOIN (SELECT DISTINCT portfolio_id, series FROM longs) s USING (portfolio_id)
  LEFT JOIN longs l ON l.portfolio_id = c.portfolio_id AND l.series = s.series AND l.date = c.date),
rebased AS (
  SELECT portfolio_id, series, date, (v / base - 1) * 100 AS pct FROM (
    SELECT *, first_value(v IGNORE NULLS) OVER (PARTITION BY portfolio_id, series ORDER BY date
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base FROM rb)
  WHERE v IS NOT NULL AND base <> 0)"""

ORACLE["cumulative_index"] = SMALL + "\nSELECT 'CDI' AS series_id, rate_date, round(cum_index, 6) AS cum_index FROM idx"

ORACLE["gap_fill"] = SMALL + "\nSELECT portfolio_id, ticker, date, round(close, 6) AS close FROM filled"

ORACLE["portfolio_series"] = SMALL + "\nSELECT portfolio_id, date, round(value, 2) AS value FROM carteira"

ORACLE["benchmark_align"] = SMALL + "\nSELECT portfolio_id, series, date, round(value, 2) AS value FROM bench"

ORACLE["rate_asof"] = SMALL + "\nSELECT portfolio_id, series, date, round(value, 6) AS cum_index FROM cdi"

ORACLE["rebased_series"] = SMALL + "\nSELECT portfolio_id, series, date, round(pct, 6) AS pct FROM rebased"

ORACLE["evolution_wide"] = SMALL + """
SELECT portfolio_id, date,
       round(max(pct) FILTER (WHERE series = 'Carteira'), 6) AS "Carteira",
       round(max(pct) FILTER (WHERE series = 'Ibovespa'), 6) AS "Ibovespa",
       round(max(pct) FILTER (WHERE series = 'IFIX'), 6) AS "IFIX",
       round(max(pct) FILTER (WHERE series = 'CDI'), 6) AS "CDI"
FROM rebased GROUP BY 1, 2"""

ORACLE["relative_performance"] = SMALL + """
, sel AS (
  SELECT portfolio_id, symbol FROM hold
  QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY row_idx) <= 3),
hs AS (
  SELECT s.portfolio_id, p.symbol, p.date, p.close FROM sel s JOIN p USING (symbol) WHERE p.close IS NOT NULL
  UNION ALL
  SELECT d.portfolio_id, p.symbol, p.date, p.close FROM (SELECT DISTINCT portfolio_id FROM sel) d
  JOIN p ON p.symbol = '^BVSP' AND p.close IS NOT NULL),
f AS (SELECT portfolio_id, min(date) AS d0 FROM hs GROUP BY 1),
b AS (SELECT hs.portfolio_id, hs.symbol, hs.close AS base FROM hs JOIN f ON hs.portfolio_id = f.portfolio_id AND hs.date = f.d0)
SELECT hs.portfolio_id, CASE WHEN hs.symbol = '^BVSP' THEN 'IBOVESPA' ELSE replace(hs.symbol, '.SA', '') END AS series,
       hs.date, round(CASE WHEN b.base <> 0 THEN (hs.close / b.base - 1) * 100 END, 6) AS pct
FROM hs LEFT JOIN b USING (portfolio_id, symbol)"""

ORACLE["portfolio_series_large"] = f"""
WITH hold0 AS (
  SELECT o.o_custkey AS portfolio_id, l.l_partkey % 456976 AS k, sum(l.l_quantity) AS quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2),
hold AS (SELECT portfolio_id, {_ticker('k')} AS ticker, {_ticker('k')} || '.SA' AS symbol, quantity
         FROM hold0 WHERE k % 10 < 9),
p AS (
  SELECT CAST(l_shipdate AS DATE) AS date, {_ticker('l_partkey')} || '.SA' AS symbol,
         floor((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + sum(CAST(l_quantity AS BIGINT)))
               / (2 * sum(CAST(l_quantity AS BIGINT)))) / 100.0 AS close
  FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1999-11-04' AND DATE '2001-11-04' GROUP BY 1, 2),
axis AS (SELECT DISTINCT h.portfolio_id, p.date FROM hold h JOIN p USING (symbol)),
grid AS (
  SELECT h.portfolio_id, h.ticker, h.symbol, h.quantity, a.date FROM hold h JOIN axis a USING (portfolio_id)
  WHERE h.symbol IN (SELECT symbol FROM p)),
filled AS (
  SELECT g.portfolio_id, g.quantity, g.date,
         coalesce(last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.portfolio_id, g.ticker ORDER BY g.date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value(p.close IGNORE NULLS) OVER (PARTITION BY g.portfolio_id, g.ticker ORDER BY g.date
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
  FROM grid g LEFT JOIN p ON p.symbol = g.symbol AND p.date = g.date)
SELECT portfolio_id, date, round(coalesce(sum(quantity * close), 0.0), 2) AS value FROM filled GROUP BY 1, 2"""

ORACLE["qty_by_ticker"] = BASE + """
SELECT portfolio_id, ticker, round(sum(quantity), 4) AS quantity FROM pos WHERE asset_type IN ('FII', 'Ação') GROUP BY 1, 2"""

ORACLE["symbol_map"] = BASE + f"""
, syms AS (
  SELECT DISTINCT {_UT} || '.SA' AS symbol FROM events
  UNION SELECT '^BVSP' UNION SELECT 'IFIX.SA'
  UNION SELECT CASE WHEN ticker LIKE '%.SA' THEN ticker ELSE ticker || '.SA' END FROM pos)
SELECT symbol,
       CASE symbol WHEN '^BVSP' THEN 'IBOVESPA' WHEN 'IFIX.SA' THEN 'IFIX' ELSE replace(symbol, '.SA', '') END AS history_name,
       CASE symbol WHEN '^BVSP' THEN 'Ibovespa' WHEN 'IFIX.SA' THEN 'IFIX' ELSE replace(symbol, '.SA', '') END AS evolution_name
FROM syms"""

# --------------------------------------------------------------- indicators
# Expected values follow from page_id alone (FIXTURES.md 2.7); no HTML parsing.
PAGES = f"""
WITH pg AS (
  SELECT page_id, {_ticker('page_id')} AS ticker, page_id % 6 AS m,
         CASE WHEN page_id % 6 = 5 THEN 404 ELSE 200 END AS status,
         page_id % 6 <> 5 AND page_id % 13 <> 0 AS hit,
         CAST(50 + page_id % 100 AS DOUBLE) AS v, CAST(5 + page_id % 10 AS DOUBLE) AS y
  FROM pages),
ex AS (
  SELECT *,
    CASE m WHEN 0 THEN v + 0.34 WHEN 2 THEN v + 1.34 END AS cell_vp,
    CASE m WHEN 0 THEN y + 0.06 END AS card_dy,
    m IN (1, 2, 3) AS has_table,
    CASE m WHEN 1 THEN v + 0.34 WHEN 2 THEN v + 2.34 END AS table_vp,
    CASE WHEN m IN (1, 2, 3) THEN y + 0.06 END AS table_dy,
    CASE WHEN m IN (1, 2, 3) THEN v + 0.34 END AS text_vp,
    CASE WHEN page_id % 4 <> 3 AND page_id % 6 <> 5 AND page_id % 13 <> 0 THEN v + 0.5 ELSE 0.0 END AS quote
  FROM pg),
ind AS (
  SELECT page_id, ticker, coalesce(cell_vp, table_vp, text_vp) AS vp, coalesce(card_dy, table_dy) AS dy
  FROM ex WHERE hit)"""

ORACLE["page_scan"] = PAGES + "\nSELECT page_id, ticker, CAST(status AS INTEGER) AS status, hit FROM pg"
ORACLE["vp_from_cells"] = PAGES + "\nSELECT page_id, round(cell_vp, 6) AS vp FROM ex WHERE hit"
ORACLE["dy_from_cards"] = PAGES + "\nSELECT page_id, round(card_dy, 6) AS dy FROM ex WHERE hit"
ORACLE["indicators_table"] = PAGES + """
SELECT page_id, has_table, round(table_vp, 6) AS vp, round(table_dy, 6) AS dy FROM ex WHERE hit"""
ORACLE["vp_from_text"] = PAGES + "\nSELECT page_id, round(text_vp, 6) AS vp FROM ex WHERE hit"
ORACLE["indicators"] = PAGES + "\nSELECT page_id, ticker, round(vp, 6) AS vp, round(dy, 6) AS dy FROM ind"
ORACLE["quotes"] = PAGES + "\nSELECT page_id, ticker, round(quote, 4) AS quote FROM ex"

LOOKUP = PAGES + f"""
, cache AS (SELECT ticker, vp, dy FROM ind WHERE page_id % 3 = 0),
req AS (SELECT DISTINCT {_ticker('p_partkey')} AS ticker FROM part)"""
ORACLE["indicator_lookup"] = LOOKUP + """
SELECT r.ticker, round(CASE WHEN c.ticker IS NOT NULL THEN c.vp ELSE i.vp END, 6) AS vp,
       round(CASE WHEN c.ticker IS NOT NULL THEN c.dy ELSE i.dy END, 6) AS dy,
       CASE WHEN c.ticker IS NOT NULL THEN 'cache' WHEN i.ticker IS NOT NULL THEN 'live' ELSE 'not_found' END AS source
FROM req r LEFT JOIN cache c USING (ticker) LEFT JOIN ind i USING (ticker)"""
ORACLE["indicator_not_found"] = LOOKUP + """
SELECT ticker FROM req WHERE ticker NOT IN (SELECT ticker FROM ind)"""

REFRESH = PAGES + f"""
, rf AS (
  SELECT {_ticker('(page_id // 6)')} AS ticker, page_id, vp, dy FROM (SELECT page_id, vp, dy FROM ind)),
lkg AS (SELECT DISTINCT ON (ticker) ticker, page_id, vp, dy FROM rf ORDER BY ticker, page_id DESC)"""
ORACLE["last_known_good"] = REFRESH + "\nSELECT ticker, round(vp, 6) AS vp, round(dy, 6) AS dy, page_id FROM lkg"
ORACLE["cache_status"] = REFRESH + "\nSELECT count(DISTINCT ticker) AS cached_tickers FROM lkg"

# -------------------------------------------------------------- rates, KPIs
# Rate entries straight from events (no JSON round trip).
ENTRIES = """
ev AS (SELECT CAST(ts AS DATE) AS d, event_type, value FROM events),
cc AS (SELECT event_type, d, sum(CAST(round(value * 100) AS BIGINT)) AS s, count(*) AS n FROM ev GROUP BY 1, 2),
ent AS (
  SELECT 'CDI' AS series_id, d, CASE WHEN day(d) % 11 = 0 THEN NULL ELSE floor((2 * s + n) / (2 * n)) / 100000.0 END AS valor
  FROM cc WHERE event_type = 'signup'
  UNION ALL SELECT 'IPCA', d, floor((2 * s + n) / (2 * n)) / 10000.0 FROM cc WHERE event_type = 'purchase'
  UNION ALL SELECT 'SELIC', d, floor((2 * s + n) / (2 * n)) / 1000.0 FROM cc WHERE event_type = 'view'),
ipca AS (SELECT valor FROM ent WHERE series_id = 'IPCA' ORDER BY d DESC LIMIT 12),
infl AS (SELECT CASE WHEN count(*) = count(valor) AND count(*) > 0 THEN product(1 + valor / 100) - 1 ELSE 0.045 END
                AS inflation FROM ipca),
selic AS (
  SELECT floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000.0 / 100 AS official_rate
  FROM events WHERE event_type = 'signup'),
sc AS (SELECT inflation, official_rate, official_rate AS used_rate FROM infl, selic)"""

ORACLE["rate_series"] = "WITH" + ENTRIES + """
SELECT series_id, d AS rate_date, round(valor, 6) AS valor FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS rn FROM ent)
WHERE rn <= 260 AND valor IS NOT NULL"""

ORACLE["named_rate"] = "WITH" + ENTRIES + "\nSELECT round(official_rate, 6) AS rate FROM selic"
ORACLE["compounded_rate"] = "WITH" + ENTRIES + "\nSELECT round(inflation, 6) AS inflation FROM infl"
ORACLE["reference_rate"] = "WITH" + ENTRIES + "\nSELECT round(official_rate, 6) AS official_rate, round(used_rate, 6) AS used_rate FROM sc"


def _dsum(expr: str) -> str:
    # Decimals read from the shortest text of each double: nothing is rounded,
    # and the total is the double nearest to the exact sum.
    return f"CAST(CAST(sum(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR) AS DOUBLE)"


KPIS = BASE + "," + ENTRIES + f"""
, ka AS (
  SELECT portfolio_id, {_dsum('market_value')} AS total_value, {_dsum('monthly_income')} AS monthly_income,
         {_dsum('invested')} AS total_invested,
         coalesce({_dsum("CASE WHEN asset_type = 'FII' THEN market_value END")}, 0.0) AS funds_value,
         coalesce({_dsum("CASE WHEN asset_type = 'Ação' THEN market_value END")}, 0.0) AS stocks_value
  FROM pos GROUP BY 1),
kb AS (
  SELECT ka.*, sc.*, funds_value + stocks_value AS variable_income_value,
         greatest(total_value - (funds_value + stocks_value), 0.0) AS other_value,
         pow(1 + inflation, 1.0 / 12) - 1 AS monthly_inflation,
         CASE WHEN total_value > 0 THEN monthly_income * 12 / total_value ELSE 0.0 END AS nominal_yield
  FROM ka, sc),
kpi AS (
  SELECT *, total_value * monthly_inflation AS upkeep,
         monthly_income - total_value * monthly_inflation AS real_income,
         total_value - total_invested AS return_value
  FROM kb)"""

ORACLE["portfolio_kpis"] = KPIS + """
SELECT portfolio_id, round(total_value, 4) AS total_value, round(total_invested, 4) AS total_invested,
       round(monthly_income, 4) AS monthly_income, round(funds_value, 4) AS funds_value,
       round(stocks_value, 4) AS stocks_value, round(variable_income_value, 4) AS variable_income_value,
       round(other_value, 4) AS other_value,
       round(CASE WHEN total_value > 0 THEN variable_income_value / total_value ELSE 0.0 END, 6) AS variable_share,
       round(CASE WHEN total_value > 0 THEN other_value / total_value ELSE 0.0 END, 6) AS other_share,
       round(return_value, 4) AS return_value,
       round(CASE WHEN total_invested > 0 THEN return_value / total_invested ELSE 0.0 END, 6) AS return_pct,
       CASE WHEN return_value >= 0 THEN 'pos' ELSE 'neg' END AS return_class
FROM kpi"""

ORACLE["real_income"] = KPIS + """
SELECT portfolio_id, round(inflation, 6) AS inflation, round(monthly_inflation, 6) AS monthly_inflation,
       round(upkeep, 4) AS upkeep, round(real_income, 4) AS real_income, round(nominal_yield, 6) AS nominal_yield,
       round((1 + nominal_yield) / (1 + inflation) - 1, 6) AS real_yield,
       round(monthly_income - real_income, 4) AS inflation_cost
FROM kpi"""

ORACLE["goal_progress"] = KPIS + """
SELECT portfolio_id, round(real_income, 4) AS real_income, round(greatest(0.0, real_income / 10000.0), 6) AS goal_progress,
       round(least(greatest(0.0, real_income / 10000.0), 1.0), 6) AS goal_bar
FROM kpi"""


def _brl(x: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', {x}), ',.', '.,')"


def _pct(x: str) -> str:
    return f"replace(format('{{:.2f}}', ({x}) * 100), '.', ',') || '%'"


_MASKED_MONEY = {"total_value_text": "total_value", "invested_text": "total_invested", "income_text": "monthly_income",
                 "return_text": "return_value", "upkeep_text": "upkeep", "real_income_text": "real_income",
                 "inflation_cost_text": "monthly_income - real_income", "variable_income_text": "variable_income_value",
                 "other_text": "other_value"}
_MASKED_SHARE = {"variable_share_text": "variable_income_value", "other_share_text": "other_value"}
_SIGN = "CASE WHEN return_value >= 0 THEN '+' ELSE '' END"
_SHOWN = [f"{_brl(x)} AS {name}" for name, x in _MASKED_MONEY.items()] + [
    _pct(f"CASE WHEN total_value > 0 THEN {x} / total_value ELSE 0.0 END") + f" AS {name}" for name, x in _MASKED_SHARE.items()]
_HIDDEN = ["'••••••'" for _ in _SHOWN]
ORACLE["masked_kpis"] = KPIS + f"""
SELECT portfolio_id, {', '.join(_SHOWN)},
       {_SIGN} || {_pct("CASE WHEN total_invested > 0 THEN return_value / total_invested ELSE 0.0 END")} AS return_pct_text,
       {_pct('used_rate')} AS rate_text
FROM kpi
UNION ALL
SELECT -portfolio_id, {', '.join(_HIDDEN)}, {_SIGN} || '••••••', {_pct('used_rate')} FROM kpi"""

ORACLE["rate_delta_label"] = KPIS + f"""
, dl AS (SELECT portfolio_id, (official_rate + (portfolio_id % 3 - 1) / 100.0) - official_rate AS d FROM kpi)
SELECT portfolio_id,
       CASE WHEN abs(d) < 1e-6 THEN 'Oficial' ELSE (CASE WHEN d > 0 THEN '+' ELSE '' END) || {_pct('d')} || ' vs oficial' END
         AS rate_delta_text,
       CASE WHEN abs(d) < 1e-6 THEN 'neu' WHEN d > 0 THEN 'pos' ELSE 'neg' END AS rate_delta_class
FROM dl"""

# ---------------------------------------------------------- sources, report
ORACLE["source_locator"] = """
WITH l AS (SELECT page_id, url, substr(sha256(url), 1, 20) AS key FROM pages)
SELECT page_id,
       CASE page_id % 5 WHEN 0 THEN key WHEN 1 THEN key WHEN 2 THEN key WHEN 3 THEN url ELSE NULL END AS doc_id,
       CAST(CASE page_id % 5 WHEN 0 THEN page_id WHEN 1 THEN 7 END AS BIGINT) AS tab_id
FROM l"""

ORACLE["snapshot_roundtrip"] = BASE + """
SELECT portfolio_id, ticker, asset_type, round(price, 4) AS price, round(market_value, 4) AS market_value,
       round(price_to_book, 6) AS price_to_book, round(dy_12m, 6) AS dy_12m, sector FROM pos"""

ORACLE["snapshot_latest"] = KPIS + """
SELECT portfolio_id, round(total_value, 4) AS total_value, round(total_invested, 4) AS total_invested,
       '2024-06-15 08:30:00' AS snapshot_ts FROM kpi"""

ORACLE["morning_report"] = KPIS + f"""
SELECT portfolio_id, round(total_value, 4) AS total_value, round(total_invested, 4) AS total_invested,
       round(total_value - total_invested, 4) AS profit,
       CASE WHEN total_value - total_invested >= 0 THEN 'green' ELSE 'red' END AS color,
       {_brl('total_value')} AS value_text, {_brl('total_invested')} AS invested_text,
       {_brl('total_value - total_invested')} AS profit_text, '📊 Morning Call: ' || {_brl('total_value')} AS subject,
       '15/06/2024 08:30:00' AS data_date
FROM kpi"""

ORACLE["report_context"] = KPIS + """
, t AS (
  SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY market_value DESC, ticker) AS rk,
         ticker || ',' || asset_type || ',' || CAST(price AS VARCHAR) || ',' || CAST(price_to_book AS VARCHAR) || ','
           || CAST(dy_12m AS VARCHAR) AS line
  FROM pos),
c AS (SELECT portfolio_id, string_agg(line, chr(10) ORDER BY rk) AS body FROM t WHERE rk <= 15 GROUP BY 1)
SELECT c.portfolio_id,
       'Ativo,Tipo,Preço Atual,P/VP,DY (12m)' || chr(10) || body || chr(10)
       || 'Patrimônio: R$ ' || printf('%.2f', k.total_value) || chr(10)
       || 'Investido: R$ ' || printf('%.2f', k.total_invested) || chr(10)
       || 'Resultado: R$ ' || printf('%.2f', k.total_value - k.total_invested) AS context
FROM c JOIN kpi k USING (portfolio_id)"""

# --------------------------------------------------------- scalar functions
SHEET = with_ctes(FIXTURE, FUND_ROWS)
ORACLE["parse_to_f"] = SHEET + """
SELECT portfolio_id, row_idx, round(quantity, 4) AS quantity, round(price, 4) AS price,
       round(book_value, 4) AS book_value, round(CAST(f.dy_hund AS DOUBLE) / 100, 4) AS dy_raw
FROM fund JOIN (SELECT k, dy_hund FROM pstat) f ON f.k = fund.row_idx % 1000000000"""
ORACLE["parse_nullable"] = SHEET + """
SELECT portfolio_id, row_idx, round(CASE WHEN book_value > 0 THEN book_value END, 4) AS book_value,
       round(avg_cost, 4) AS avg_cost FROM fund"""
ORACLE["scale_dy"] = SHEET + "\nSELECT portfolio_id, row_idx, round(dy_12m, 6) AS dy_12m FROM fund"
ORACLE["fmt_currency"] = BASE + f"\nSELECT portfolio_id, ticker, asset_type, {_brl('market_value')} AS value_text FROM pos"
ORACLE["fmt_percent"] = BASE + f"\nSELECT portfolio_id, ticker, asset_type, {_pct('dy_12m')} AS dy_text FROM pos"
ORACLE["valid_ticker"] = SHEET + "\nSELECT portfolio_id, row_idx, regexp_matches(ticker, '^[A-Z]{4}11[B]?$') AS valid FROM fund"
ORACLE["normalize_sector"] = BASE + """
SELECT portfolio_id, ticker, asset_type, upper(trim(strip_accents(sector))) AS sector_norm FROM pos"""
ORACLE["resolve_ex_date"] = BASE + AGENDA + """
, allf AS (SELECT portfolio_id, row_idx, row_idx % 1000000000 AS k,
                  DATE '2024-06-01' + CAST((row_idx % 1000000000) % 90 AS INTEGER) AS d0 FROM fund)
SELECT portfolio_id, row_idx,
  CASE k % 6 WHEN 0 THEN d0 WHEN 5 THEN d0
    WHEN 1 THEN CASE WHEN d0 < DATE '2024-06-15' THEN CAST(d0 + INTERVAL 1 YEAR AS DATE) ELSE d0 END
    WHEN 2 THEN (SELECT bd.d FROM bd WHERE bd.n = CASE WHEN isodow(DATE '2024-06-01') > 5
                                                    THEN greatest(allf.k % 22, 1) ELSE allf.k % 22 + 1 END)
    WHEN 3 THEN (SELECT max(bd.d) FROM bd WHERE month(bd.d) = 6) END AS ex_date
FROM allf"""

ORACLE["nth_business_day"] = """
WITH cal AS (
  SELECT CAST(d AS DATE) AS d FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2026-03-01', INTERVAL 1 DAY) t(d)),
m AS (SELECT p_partkey AS k, CAST(DATE '2024-01-01' + to_months(CAST(p_partkey % 24 AS INTEGER)) AS DATE) AS m0,
             CAST(p_partkey % 25 AS INTEGER) AS n FROM part),
bdays AS (
  SELECT m.k, c.d, row_number() OVER (PARTITION BY m.k ORDER BY c.d) AS i
  FROM m JOIN cal c ON c.d >= m.m0 AND c.d < m.m0 + INTERVAL 45 DAY AND isodow(c.d) <= 5)
SELECT m.k, m.m0 AS month_start, m.n,
       (SELECT b.d FROM bdays b WHERE b.k = m.k AND b.i = CASE WHEN isodow(m.m0) > 5 THEN greatest(m.n - 1, 1) ELSE m.n END
        AND m.n >= 1) AS business_day
FROM m"""

ORACLE["last_business_day"] = """
WITH mm AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS m0 FROM orders),
cal AS (SELECT m0, CAST(m0 + to_days(CAST(i AS INTEGER)) AS DATE) AS d
        FROM mm, range(0, 31) r(i))
SELECT m0 AS month_start, max(d) AS last_business_day FROM cal
WHERE month(d) = month(m0) AND isodow(d) <= 5 GROUP BY 1"""

ORACLE["month_label"] = """
SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       ['Janeiro', 'Fevereiro', 'Março', 'Abril', 'Maio', 'Junho', 'Julho', 'Agosto', 'Setembro', 'Outubro',
        'Novembro', 'Dezembro'][month(o_orderdate)] || ' / ' || CAST(year(o_orderdate) AS VARCHAR) AS label
FROM orders"""

ORACLE["strip_fences"] = """
SELECT doc_id, CAST(length(s) AS BIGINT) AS n_chars, sha256(s) AS digest FROM (
  SELECT doc_id, replace(replace('```html' || chr(10) || text || chr(10) || '```', '```html', ''), '```', '') AS s
  FROM documents)"""

ORACLE["price_panel"] = SMALL + """
SELECT date, symbol, round(close, 6) AS close FROM p
WHERE symbol IN (SELECT symbol FROM hold) OR symbol IN ('^BVSP', 'IFIX.SA')"""

ORACLE["last_known_good_stream"] = ORACLE["last_known_good"]


# Sheet files: which sheets exist and how wide they are (the fixed shapes of the sheet fixtures).
SHEETS = """
fund_file AS (
  SELECT portfolio_id, source_rank, row_number() OVER (PARTITION BY portfolio_id ORDER BY row_idx) - 1 AS row_idx, ticker, asset_type,
         CASE WHEN portfolio_id % 11 = 5 THEN 'Indefinido' ELSE sector END AS sector, quantity, avg_cost, price, book_value, dy_12m,
         CASE WHEN portfolio_id % 11 = 5 THEN '-' ELSE ex_date_text END AS ex_date_text, link
  FROM fund WHERE portfolio_id % 13 <> 4 AND portfolio_id % 11 <> 3),
manual_file AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY portfolio_id ORDER BY row_idx) - 1 AS row_idx)
  FROM manual WHERE portfolio_id % 7 <> 2 AND portfolio_id % 13 <> 9)"""

ORACLE["sheet_positional"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS, SHEETS) + f"\nSELECT {POSITION_COLS} FROM fund_file"

ORACLE["sheet_headed"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS, SHEETS) + f"""
SELECT {POSITION_COLS} FROM (
  SELECT m.* REPLACE (CASE WHEN asset_type = 'Ação' THEN avg_cost ELSE price END AS price) FROM manual_file m)"""

ORACLE["source_ledger"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS) + """,
f AS (SELECT portfolio_id, count(*) AS n, max(CASE WHEN portfolio_id % 11 = 7 AND row_idx % 3 = 0 THEN 30 ELSE 25 END) AS w
      FROM fund WHERE portfolio_id % 13 <> 4 GROUP BY 1),
m AS (SELECT portfolio_id, CASE WHEN portfolio_id % 13 = 9 THEN 0 ELSE count(*) + 1 END AS n FROM manual GROUP BY 1)
SELECT 'fund' AS kind, c_custkey AS portfolio_id,
  CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey % 11 = 3 THEN 'narrow' ELSE 'ok' END AS status, coalesce(n, 0) AS n_rows,
  CAST(CASE WHEN n IS NULL THEN 0 WHEN c_custkey % 11 = 3 THEN 12 WHEN c_custkey % 11 = 5 THEN 18 ELSE w END AS INTEGER) AS width
FROM customer LEFT JOIN f ON portfolio_id = c_custkey
UNION ALL
SELECT 'manual', c_custkey,
  CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey % 7 = 2 THEN 'narrow' WHEN n = 0 THEN 'empty' ELSE 'ok' END, coalesce(n, 0),
  CAST(CASE WHEN n IS NULL THEN 0 WHEN c_custkey % 7 = 2 THEN 3 WHEN c_custkey % 7 = 3 THEN 6 ELSE 4 END AS INTEGER)
FROM customer LEFT JOIN m ON portfolio_id = c_custkey"""

ORACLE["positions_from_sheets"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS, SHEETS, POSITIONS.replace(
    "SELECT * FROM fund UNION ALL SELECT * FROM manual", "SELECT * FROM fund_file UNION ALL SELECT * FROM manual_file")) + """
SELECT portfolio_id, ticker, asset_type, sector, ex_date_text, round(market_value, 4) AS market_value, round(profit, 4) AS profit,
       round(weight, 6) AS weight FROM pos"""


# Parameters by portfolio (the fixed overrides of the parameter stand-in) and the rate chain.
def _params(official: str) -> str:
    return f"""
, k0 AS (
  SELECT c_custkey AS portfolio_id, 
    CASE WHEN c_custkey % 4 = 0 THEN 0.95 ELSE 0.8 END AS pvp_min,
    greatest(CASE WHEN c_custkey % 4 = 0 THEN 0.95 ELSE 0.8 END, CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 0.99 END) AS pvp_max,
    CASE WHEN c_custkey % 4 = 1 THEN 0.085 ELSE 0.09 END AS dy_min,
    CASE WHEN c_custkey % 4 = 1 THEN greatest(c_acctbal, 0) ELSE 1000 END AS contribution_min,
    CASE WHEN c_custkey % 8 = 6 THEN 0.15 ELSE ({official}) END AS used_rate,
    CASE WHEN c_custkey % 4 = 2 THEN 0.5 ELSE 0.6 END AS brick_pct, CASE WHEN c_custkey % 4 = 2 THEN 0.9 ELSE 0.8 END AS paper_pct
  FROM customer)"""


_NAMED_RATE = """SELECT floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000.0 / 100
  FROM events WHERE event_type = 'signup'"""
_SERIES_RATE = """SELECT max_by(valor, d) / 100 FROM (
  SELECT CAST(ts AS DATE) AS d, floor((2 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000.0 AS valor
  FROM events WHERE event_type = 'view' GROUP BY 1)"""

ORACLE["opportunities_by_params"] = BASE + _params(_NAMED_RATE) + """
, opp AS (
  SELECT p.*, k.contribution_min, greatest(0.0, m.total_value / m.n_positions - p.market_value) AS suggested_contribution
  FROM pos p JOIN means m USING (portfolio_id) JOIN k0 k USING (portfolio_id)
  WHERE p.asset_type = 'FII' AND p.price_to_book BETWEEN k.pvp_min AND k.pvp_max AND p.dy_12m >= k.dy_min
    AND p.weight < m.mean_weight),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY price_to_book, dy_12m DESC,
                               suggested_contribution DESC, source_rank, row_idx) AS rank
  FROM opp WHERE suggested_contribution >= contribution_min)
SELECT portfolio_id, CAST(rank AS INTEGER) AS rank, ticker, sector, segment, round(price, 4) AS price,
       round(price_to_book, 6) AS price_to_book, round(dy_12m, 6) AS dy_12m, round(weight, 6) AS weight,
       round(market_value, 4) AS market_value, round(suggested_contribution, 2) AS suggested_contribution, link
FROM ranked WHERE rank <= 4"""


def _risk_by(official: str) -> str:
    return BASE + _params(official) + RISK.replace(
        "0.12 * CASE WHEN p.segment = 'Tijolo' THEN 0.6 ELSE 0.8 END",
        "k.used_rate * CASE WHEN p.segment = 'Tijolo' THEN k.brick_pct ELSE k.paper_pct END").replace(
        "SELECT p.*, ", "SELECT p.*, k.used_rate,").replace(
        "FROM pos p JOIN means m USING (portfolio_id)", "FROM pos p JOIN means m USING (portfolio_id) JOIN k0 k USING (portfolio_id)")


ORACLE["risk_by_params"] = _risk_by(_NAMED_RATE) + """
SELECT portfolio_id, ticker, round(used_rate, 6) AS used_rate, risk_reasons, risk_rank, risk_label FROM risk3"""
ORACLE["risk_by_series_rate"] = _risk_by(_SERIES_RATE) + """
SELECT portfolio_id, ticker, round(used_rate, 6) AS used_rate, risk_rank FROM risk3"""
ORACLE["risk_by_default_rate"] = _risk_by("0.12::DOUBLE") + """
SELECT portfolio_id, ticker, round(used_rate, 6) AS used_rate, risk_rank FROM risk3"""

ORACLE["private_sections"] = f"""
SELECT 'opportunities' AS section, portfolio_id, rank, ticker FROM ({ORACLE["opportunities"]}) WHERE portfolio_id % 2 = 0
UNION ALL
SELECT 'radar', portfolio_id, rank, ticker FROM ({ORACLE["risk_radar"]}) WHERE portfolio_id % 2 = 0"""


def _power(n: str) -> str:
    return f"CASE {n} % 33 " + " ".join(f"WHEN {i} THEN 1e{i - 12}::DOUBLE" for i in range(33)) + " END"


ORACLE["report_context_wide"] = ORACLE["report_context"].replace(
    "CAST(price AS VARCHAR)", f"CAST(quantity * ({_power('row_idx')}) AS VARCHAR)")

ORACLE["number_text"] = f"""
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * (1 - l_discount) * ({_power('(l_orderkey + l_linenumber)')}) AS VARCHAR) AS text
FROM lineitem"""


# Closes that are no numbers (the fixed rule of the holed panel) are gaps.
ORACLE["portfolio_series_holed"] = SMALL.replace(
    "p AS (SELECT * FROM panel WHERE", "p AS (SELECT date, symbol, CASE WHEN (day(date) + ascii(substr(symbol, 4, 1))) % 15 IN (3, 7, 11) "
    "THEN NULL ELSE close END AS close FROM panel WHERE") + "\nSELECT portfolio_id, date, round(value, 2) AS value FROM carteira"

ORACLE["totals_text"] = KPIS + """
SELECT portfolio_id, CAST(printf('%.2f', total_value) AS DOUBLE) AS total_value,
       CAST(printf('%.2f', total_invested) AS DOUBLE) AS total_invested FROM kpi"""

ORACLE["valid_ticker_mixed"] = "SELECT p_partkey AS k, p_partkey % 8 IN (0, 1, 5) AS valid FROM part"

# Figures of rows whose price, cost or yield is no number: such a number counts as 0 wherever it would show.
ORACLE["valuation_scrubbed"] = with_ctes(FIXTURE, FUND_ROWS, MANUAL_ROWS, POSITIONS.replace(
    "sum(market_value) OVER (PARTITION BY portfolio_id)", "1.0")) + """
, d AS (SELECT *, row_idx % 7 AS n, asset_type IN ('FII', 'Ação') AS units FROM dedup),
v AS (
  SELECT *, CASE WHEN n IN (0, 1) THEN 0.0 ELSE price END AS pr,
         CASE WHEN n = 2 THEN 0.0 ELSE avg_cost END AS co, CASE WHEN n = 3 THEN 0.0 ELSE dy_12m END AS dy,
         CASE WHEN n IN (0, 1) THEN 0.0 WHEN units THEN quantity * price ELSE price END AS mv,
         CASE WHEN units AND n <> 2 AND avg_cost > 0 THEN quantity * avg_cost
              WHEN n IN (0, 1) THEN 0.0 WHEN units THEN quantity * price ELSE price END AS inv
  FROM d)
SELECT portfolio_id, ticker, asset_type, round(pr, 4) AS price, round(co, 4) AS avg_cost, round(dy, 6) AS dy_12m,
       round(mv, 4) AS market_value, round(inv, 4) AS invested,
       round(CASE WHEN n IN (0, 1) THEN 0.0 ELSE mv - inv END, 4) AS profit,
       round(CASE WHEN asset_type = 'FII' AND n NOT IN (0, 1, 3) THEN mv * dy / 12 ELSE 0.0 END, 4) AS monthly_income,
       round(CASE WHEN book_value > 0 THEN pr / book_value ELSE 0.0 END, 6) AS price_to_book,
       round(CASE WHEN inv > 0 THEN mv / inv - 1 ELSE 0.0 END, 6) AS return_pct
FROM v"""


ORACLE["inflation_fallback"] = "WITH" + ENTRIES + """
SELECT round(CASE WHEN count(*) = count(valor) THEN product(1 + valor / 100) - 1 ELSE 0.045 END, 6) AS inflation
FROM (SELECT valor FROM ent WHERE series_id = 'CDI' ORDER BY d DESC LIMIT 12)"""

ORACLE["reference_rate_chain"] = "WITH" + ENTRIES + """,
r AS (SELECT official_rate AS named, (SELECT max_by(valor, d) / 100 FROM ent WHERE series_id = 'SELIC') AS series FROM selic)
SELECT branch, round(official, 6) AS official_rate, round(used, 6) AS used_rate FROM (
  SELECT 'named' AS branch, named AS official, named AS used FROM r
  UNION ALL SELECT 'series', series, series FROM r
  UNION ALL SELECT 'default', 0.12::DOUBLE, 0.12::DOUBLE FROM r
  UNION ALL SELECT 'user', named, 0.13::DOUBLE FROM r)"""
