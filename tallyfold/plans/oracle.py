"""DuckDB SQL of the registered queries, written another way than the operators where there is one."""

from __future__ import annotations

_PARTS = {
    "tr": """SELECT o_custkey AS account_id, l_partkey AS instrument_id, o_orderdate::DATE AS trade_date,
  CASE l_returnflag WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity,
  l_quantity * CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS signed_quantity, l_extendedprice / nullif(l_quantity, 0) AS price,
  l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pr": "SELECT l_partkey AS instrument_id, l_shipdate::DATE AS price_date, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS close FROM lineitem GROUP BY ALL",
    "co": "SELECT p_partkey AS instrument_id, p_name AS name, p_type AS sector, p_brand AS industry FROM part",
    "ps": "SELECT account_id, instrument_id, sum(signed_quantity) AS quantity FROM tr GROUP BY ALL HAVING sum(signed_quantity) <> 0",
    "ob": "SELECT * FROM pr WHERE close IS NOT NULL",
    "lp": "SELECT DISTINCT ON (instrument_id) instrument_id, close FROM ob ORDER BY instrument_id, price_date DESC",
    "mv": "SELECT account_id, instrument_id, quantity, close, quantity * close AS value FROM ps LEFT JOIN lp USING (instrument_id)",
    "wt": "SELECT account_id, instrument_id, value, value / nullif(g, 0) AS weight FROM mv JOIN (SELECT account_id, sum(abs(value)) AS g FROM mv GROUP BY ALL) USING (account_id)",
    "rt": """SELECT instrument_id, price_date, close / nullif(before, 0) - 1 AS ret
  FROM (SELECT *, first_value(close) OVER (PARTITION BY instrument_id ORDER BY price_date ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before FROM ob) WHERE before IS NOT NULL""",
    "rk": """SELECT instrument_id, count(ret) AS observations, avg(ret) AS mean, stddev_samp(ret) AS stddev, quantile_cont(ret, 0.05) AS var_95,
  avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM rt GROUP BY instrument_id HAVING count(ret) >= 10""",
    "mk": "SELECT price_date, avg(ret) AS market FROM rt GROUP BY price_date",
    "bt": """SELECT instrument_id, count(ret) AS observations, covar_samp(ret, market) / nullif(var_samp(market), 0) AS beta
  FROM rt JOIN mk USING (price_date) GROUP BY instrument_id HAVING count(ret) >= 10""",
    "mo": """SELECT instrument_id, price_date, late / nullif(early, 0) - 1 AS momentum
  FROM (SELECT *, first_value(close) OVER (PARTITION BY instrument_id ORDER BY price_date ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS late,
    first_value(close) OVER (PARTITION BY instrument_id ORDER BY price_date ROWS BETWEEN 10 PRECEDING AND 10 PRECEDING) AS early FROM ob) WHERE late IS NOT NULL AND early IS NOT NULL""",
    "rn": """SELECT account_id, instrument_id, trade_date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, price, signed_quantity AS q,
  row_number() OVER w AS i, coalesce(sum(signed_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held
  FROM tr WINDOW w AS (PARTITION BY account_id, instrument_id ORDER BY trade_date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, signed_quantity, price)""",
    "mf": "SELECT *, CASE WHEN q * held < 0 THEN least(abs(q), abs(held)) ELSE 0 END AS closed, abs(q) - CASE WHEN q * held < 0 THEN least(abs(q), abs(held)) ELSE 0 END AS opened FROM rn",
    "dd": """SELECT instrument_id, min(close / nullif(peak, 0) - 1) AS max_drawdown
  FROM (SELECT instrument_id, close, max(close) OVER (PARTITION BY instrument_id ORDER BY price_date) AS peak FROM ob) GROUP BY instrument_id""",
}
_NEEDS = {
    "ps": "tr", "ob": "pr", "lp": "ob", "mv": "ps lp", "wt": "mv", "rt": "ob", "rk": "rt", "mk": "rt", "bt": "rt mk", "mo": "ob", "dd": "ob", "rn": "tr", "mf": "rn",
}


def _with(parts: str, select: str) -> str:
    """select after the named parts and all that they need."""
    order: list[str] = []

    def need(part: str) -> None:
        for other in _NEEDS.get(part, "").split():
            need(other)
        if part not in order:
            order.append(part)

    for part in parts.split():
        need(part)
    return "WITH " + ",\n".join(f"{p} AS ({_PARTS[p]})" for p in order) + "\n" + select


def _r(column: str, places: int = 6, name: str | None = None) -> str:
    return f"round({column} + 1e-{places + 3}, {places}) + 0.0 AS {name or column}"


_RISK = ", ".join(_r(c) for c in ("mean", "stddev", "var_95", "sharpe"))

SQL = {
    "o01_trades": _with("tr", f"SELECT * REPLACE ({_r('price')}) FROM tr"),
    "o02_positions": _with("ps", "SELECT * FROM ps"),
    "o03_latest_price": _with("lp", f"SELECT instrument_id, {_r('close')} FROM lp"),
    "o04_market_value": _with("mv", f"SELECT account_id, instrument_id, quantity, {_r('close')}, {_r('value', 2)} FROM mv"),
    "o05_weights": _with("wt", f"SELECT account_id, instrument_id, {_r('value', 2)}, {_r('weight')} FROM wt"),
    "o06_concentration": _with("wt", f"SELECT account_id, count(*) AS holdings, {_r('sum(weight * weight)', name='hhi')} FROM wt GROUP BY account_id"),
    "o07_allocation": _with("mv co", """, own AS (SELECT value, sector, industry FROM mv LEFT JOIN co USING (instrument_id))
SELECT sector, industry, 0::INTEGER AS level, round(sum(abs(value)) + 1e-5, 2) + 0.0 AS gross_value, count(*) AS holdings FROM own GROUP BY sector, industry
UNION ALL SELECT sector, NULL, 1, round(sum(abs(value)) + 1e-5, 2) + 0.0, count(*) FROM own GROUP BY sector
UNION ALL SELECT NULL, NULL, 3, round(sum(abs(value)) + 1e-5, 2) + 0.0, count(*) FROM own"""),
    "o08_running_position": _with("tr", """SELECT account_id, instrument_id, trade_date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, signed_quantity,
  sum(signed_quantity) OVER (PARTITION BY account_id, instrument_id ORDER BY trade_date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS position FROM tr"""),
    "o09_price_as_of": _with("tr ob", f"""SELECT account_id, tr.instrument_id, trade_date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, {_r('close')}
FROM tr ASOF LEFT JOIN ob ON tr.instrument_id = ob.instrument_id AND trade_date >= price_date"""),
    "o10_value_series": _with("tr ob", f""", dy AS (SELECT account_id, instrument_id, trade_date, sum(signed_quantity) AS change FROM tr GROUP BY ALL),
sp AS (SELECT account_id, instrument_id, trade_date AS since, lead(trade_date) OVER o AS until, sum(change) OVER o AS position FROM dy
  WINDOW o AS (PARTITION BY account_id, instrument_id ORDER BY trade_date))
SELECT account_id, price_date, {_r('sum(position * close)', 2, 'value')} FROM sp JOIN ob ON sp.instrument_id = ob.instrument_id AND price_date >= since AND price_date < coalesce(until, DATE '9999-12-31')
WHERE position <> 0 GROUP BY account_id, price_date"""),
    "o11_average_buy_cost": _with("tr", f"""SELECT account_id, instrument_id,
  {_r("sum(quantity * price) FILTER (side = 'BUY') / nullif(sum(quantity) FILTER (side = 'BUY'), 0)", name='average_cost')} FROM tr GROUP BY account_id, instrument_id"""),
    "o12_drift": _with("wt tr", f""", held AS (SELECT DISTINCT account_id, instrument_id FROM tr),
tg AS (SELECT account_id, instrument_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY account_id) AS target FROM held),
b AS (SELECT account_id, instrument_id, coalesce(weight, 0) AS weight, coalesce(target, 0) AS target FROM wt FULL JOIN tg USING (account_id, instrument_id))
SELECT account_id, instrument_id, {_r('weight')}, {_r('target')}, {_r('weight - target', name='drift')} FROM b WHERE abs(weight - target) > 0.05"""),
    "o13_unpriced": _with("tr ob", """, d(as_of) AS (VALUES (DATE '1995-06-01'), (DATE '1998-01-01'), (NULL)),
h AS (SELECT as_of, account_id, instrument_id, sum(signed_quantity) AS quantity FROM tr JOIN d ON trade_date <= coalesce(as_of, DATE '9999-12-31') GROUP BY ALL HAVING sum(signed_quantity) <> 0)
SELECT * FROM h WHERE NOT EXISTS (FROM ob WHERE ob.instrument_id = h.instrument_id AND price_date <= coalesce(as_of, DATE '9999-12-31'))"""),
    "o14_daily_prices": _with("pr", f"SELECT instrument_id, price_date, {_r('close')} FROM pr"),
    "o15_returns": _with("rt", f"SELECT instrument_id, price_date, {_r('ret')} FROM rt"),
    "o16_rolling_stats": _with("rt", """SELECT instrument_id, price_date, CASE WHEN count(ret) OVER w = 5 THEN round(avg(ret) OVER w + 1e-9, 6) + 0.0 END AS mean,
  CASE WHEN count(ret) OVER w = 5 THEN round(stddev_samp(ret) OVER w + 1e-9, 6) + 0.0 END AS stddev FROM rt
WINDOW w AS (PARTITION BY instrument_id ORDER BY price_date ROWS 4 PRECEDING)"""),
    "o17_max_drawdown": _with("dd", f"SELECT instrument_id, {_r('max_drawdown')} FROM dd"),
    "o18_risk_summary": _with("rk", f"SELECT instrument_id, observations, {_RISK} FROM rk"),
    "o19_beta": _with("bt", f"SELECT instrument_id, observations, {_r('beta')} FROM bt"),
    "o20_sector_correlation": _with("rt co", f""", s AS (SELECT sector, price_date, avg(ret) AS ret FROM rt JOIN co USING (instrument_id) WHERE sector IS NOT NULL GROUP BY ALL)
SELECT a.sector AS sector_a, b.sector AS sector_b, count(*) AS dates, {_r('corr(a.ret, b.ret)', name='correlation')}
FROM s a JOIN s b ON a.price_date = b.price_date AND a.sector < b.sector GROUP BY ALL"""),
    "o21_peer_compare": _with("rk co", ", o AS (SELECT * FROM rk JOIN co USING (instrument_id))\nSELECT instrument_id, sector, " + ", ".join(
        f"{_r(f'({m} - avg({m}) OVER w) / nullif(stddev_samp({m}) OVER w, 0)', name=f'{m}_z')}, {_r(f'median({m}) OVER w', name=f'{m}_median')}" for m in ("mean", "stddev")
    ) + " FROM o WINDOW w AS (PARTITION BY sector)"),
    "o22_momentum": _with("mo", f"SELECT instrument_id, price_date, {_r('momentum')} FROM mo"),
    "o23_opportunities": _with("rk co ps", """, c AS (SELECT sector, instrument_id, round(mean, 6) AS mean FROM rk JOIN co USING (instrument_id)
  WHERE mean > 0 AND observations >= 10 AND instrument_id NOT IN (SELECT instrument_id FROM ps WHERE account_id = 7))
SELECT sector, (row_number() OVER (PARTITION BY sector ORDER BY mean DESC, instrument_id))::INTEGER AS place, instrument_id, round(mean + 1e-9, 6) + 0.0 AS mean,
  round(percent_rank() OVER (PARTITION BY sector ORDER BY mean DESC) + 1e-9, 6) + 0.0 AS standing FROM c QUALIFY place <= 5"""),
    "o24_company_terms": r"""
WITH t AS (SELECT source AS company_id, unnest(string_split_regex(lower(text), '[ \n\t\r.,;:!?()]+')) AS term FROM documents WHERE source IS NOT NULL),
c AS (SELECT company_id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
s AS (SELECT company_id, term, tf, count(*) OVER (PARTITION BY term) AS df FROM c),
r AS (SELECT *, round(tf * ln((SELECT count(DISTINCT company_id) FROM c) / df), 6) AS score FROM s)
SELECT company_id, term, tf, df, score, (row_number() OVER (PARTITION BY company_id ORDER BY score DESC, term))::INTEGER AS place FROM r QUALIFY place <= 10""",
    "o25_document_summary": """
SELECT source AS company_id, lang, count(*) AS documents, count(DISTINCT text) AS distinct_texts, round(avg(n_chars) + 1e-9, 6) + 0.0 AS mean_chars,
  round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) + 1e-9, 6) + 0.0 AS labelled_share, round(avg(quality) + 1e-9, 6) + 0.0 AS mean_quality, round(avg(toxic) + 1e-9, 6) + 0.0 AS toxic_rate
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source, lang""",
    "o26_company_profile": _with("co rk bt mo dd", f""", lm AS (SELECT instrument_id, arg_max(momentum, price_date) AS momentum FROM mo GROUP BY instrument_id)
SELECT instrument_id, name, sector, industry, rk.observations, {_RISK}, {_r('beta')}, {_r('momentum')}, {_r('max_drawdown')}
FROM co LEFT JOIN rk USING (instrument_id) LEFT JOIN bt USING (instrument_id) LEFT JOIN lm USING (instrument_id) LEFT JOIN dd USING (instrument_id)"""),
    "o27_realised_profit": _with("mf", """, p AS (SELECT account_id, instrument_id, q > 0 AS long, TRUE AS opens, price, sum(opened) OVER w AS until, opened AS size FROM mf WHERE opened > 0 WINDOW w AS (PARTITION BY account_id, instrument_id, q > 0 ORDER BY i)
UNION ALL SELECT account_id, instrument_id, q < 0, FALSE, price, sum(closed) OVER w, closed FROM mf WHERE closed > 0 WINDOW w AS (PARTITION BY account_id, instrument_id, q < 0 ORDER BY i)),
m AS (SELECT account_id, instrument_id, least(a.until, b.until) - greatest(a.until - a.size, b.until - b.size) AS quantity, (b.price - a.price) * CASE WHEN long THEN 1 ELSE -1 END AS gain
  FROM p a JOIN p b USING (account_id, instrument_id, long) WHERE a.opens AND NOT b.opens AND a.until > b.until - b.size AND b.until > a.until - a.size)
SELECT account_id, instrument_id, sum(quantity) AS closed, count(*) AS matches, round(sum(quantity * gain) + 1e-5, 2) + 0.0 AS profit FROM m GROUP BY ALL"""),
    "o28_average_cost": "WITH RECURSIVE" + _with("mf", f""", r AS (SELECT account_id, instrument_id, i, held + q AS position, opened * price AS cost FROM mf WHERE i = 1
UNION ALL SELECT account_id, instrument_id, f.i, f.held + q, CASE WHEN f.held = 0 THEN 0 ELSE cost * (abs(f.held) - closed) / abs(f.held) END + opened * price
  FROM r JOIN mf f USING (account_id, instrument_id) WHERE f.i = r.i + 1)
SELECT account_id, instrument_id, trade_date, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, position, {_r("CASE WHEN position <> 0 THEN cost / abs(position) END", name="average_cost")}
FROM r JOIN mf USING (account_id, instrument_id, i)""").removeprefix("WITH"),
    "o29_instrument_correlation": _with("rt", f""", c AS (SELECT a.instrument_id, b.instrument_id AS other_id, count(*) AS dates, round(corr(a.ret, b.ret), 6) AS correlation, stddev_pop(a.ret) AS da, stddev_pop(b.ret) AS db
  FROM rt a JOIN rt b ON a.price_date = b.price_date AND a.instrument_id <> b.instrument_id AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY correlation DESC, other_id)::INTEGER AS place, other_id, dates, {_r("correlation")} FROM c WHERE da > 0 AND db > 0 QUALIFY place <= 5"""),
    "o30_pareto_front": _with("rk mo", f""", lm AS (SELECT instrument_id, arg_max(momentum, price_date) AS momentum FROM mo GROUP BY instrument_id),
m AS (SELECT instrument_id, {_r("mean")}, {_r("stddev")}, {_r("var_95")}, {_r("momentum")} FROM rk JOIN lm USING (instrument_id)), f AS (SELECT * FROM m WHERE mean + stddev + var_95 + momentum IS NOT NULL)
SELECT * FROM f WHERE NOT EXISTS (FROM f AS b WHERE b.mean >= f.mean AND b.stddev <= f.stddev AND b.var_95 >= f.var_95 AND b.momentum >= f.momentum
  AND (b.mean > f.mean OR b.stddev < f.stddev OR b.var_95 > f.var_95 OR b.momentum > f.momentum))"""),
    "o31_position_stream": _with("ps", "SELECT * FROM ps"),
    "o32_weighted_stats": "WITH RECURSIVE" + _with("rt", f""", n AS (SELECT instrument_id, price_date, ret, row_number() OVER (PARTITION BY instrument_id ORDER BY price_date) AS i FROM rt WHERE ret IS NOT NULL),
e AS (SELECT instrument_id, i, price_date, ret AS mean, 0.0::DOUBLE AS variance FROM n WHERE i = 1
UNION ALL SELECT instrument_id, n.i, n.price_date, mean + 0.06::DOUBLE * (ret - mean), 0.94::DOUBLE * (variance + 0.06::DOUBLE * (ret - mean) * (ret - mean)) FROM e JOIN n USING (instrument_id) WHERE n.i = e.i + 1)
SELECT instrument_id, price_date, {_r("mean")}, {_r("sqrt(variance)", name="deviation")} FROM e""").removeprefix("WITH"),
    "o33_positions_as_of": _with("tr", """, d(as_of) AS (VALUES (DATE '1993-03-31'), (DATE '1995-06-01'), (DATE '1997-12-31'), (DATE '2000-01-01'))
SELECT as_of, account_id, instrument_id, sum(signed_quantity) AS quantity FROM tr JOIN d ON trade_date <= as_of GROUP BY ALL HAVING sum(signed_quantity) <> 0"""),
    "o34_span_quantiles": _with("rt", f"""SELECT instrument_id, count(*) AS observations, {_r("quantile_disc(ret, 0.05)", name="q05")}, {_r("quantile_disc(ret, 0.5)", name="median")}, {_r("quantile_disc(ret, 0.95)", name="q95")}
FROM rt WHERE ret IS NOT NULL AND price_date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' GROUP BY instrument_id"""),
    "o35_distinct_counts": """
SELECT CASE grouping(source, lang) WHEN 1 THEN 'company' WHEN 2 THEN 'language' ELSE 'all' END AS level, source AS company_id, lang, count(*) AS documents, count(DISTINCT text) AS distinct_texts
FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""",
    "o36_stored_fills": _with("tr", f"SELECT * REPLACE ({_r('price')}) FROM tr"),
}
