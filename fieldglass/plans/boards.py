"""Registered queries: attrition, harvest frontier, catalogs, logs and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attrition as T
from ..operators import harvest as H
from ..operators import knowledge as K
from ..operators import logs as L
from ..operators import series as S
from .bridge import EV_ORDERS, LOG, READINGS, ev_orders, log, readings
from .core import O as CORE
from .core import _ESC, _SAT, EV_STREAM, ev_stream

Q, O = {}, {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


_R = lambda df, *cols, n=6: df.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) if c in cols else c for c in df.columns])
_table = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")

# Attrition ----------------------------------------------------------------------------------------------------------
_COL = f"WITH {READINGS}, co AS (SELECT category, side, date, sum(produced) AS produced, sum(lost) AS lost, arg_max(inventory, seq) FILTER (WHERE inventory IS NOT NULL) AS inventory FROM rd WHERE date IS NOT NULL GROUP BY 1, 2, 3)"
_TRJ = _COL + """, ru AS (SELECT *, produced - lost AS net, sum(produced - lost) OVER (PARTITION BY category, side ORDER BY date) AS run, min(date) FILTER (WHERE inventory IS NOT NULL) OVER (PARTITION BY category, side) AS since FROM co),
an AS (SELECT category, side, inventory AS anchor, run AS was FROM ru WHERE date = since),
tr AS (SELECT ru.category, ru.side, ru.date, produced, lost, net, greatest(0.0, CASE WHEN anchor IS NULL THEN run ELSE anchor + run - was END) AS stock FROM ru LEFT JOIN an ON ru.category = an.category AND ru.side = an.side)"""
_PRJ = _TRJ + """, pb AS (SELECT *, max(date) OVER p AS last, min(date) OVER p AS first, row_number() OVER (PARTITION BY category, side ORDER BY date DESC) AS back FROM tr WINDOW p AS (PARTITION BY category, side)),
pc AS (SELECT *, count(*) FILTER (WHERE last - date <= 180) OVER (PARTITION BY category, side) AS k FROM pb), pu AS (SELECT *, CAST(date - first AS DOUBLE) AS x FROM pc WHERE CASE WHEN k >= 2 THEN last - date <= 180 ELSE back <= 2 END),
pg AS (SELECT category, side, max(last) AS last, arg_max(stock, date) AS current, count(*) AS points, coalesce(regr_slope(stock, x), 0) AS slope, sqrt(greatest(0, (regr_syy(stock, x) - regr_slope(stock, x) * regr_sxy(stock, x)) / count(*))) AS sigma FROM pu GROUP BY 1, 2),
pj AS (SELECT *, CASE WHEN slope < 0 AND current > 0 THEN current / -slope END AS days_left FROM pg)"""
_PJ_COLS = "category, side, last, current, points, round(slope, 4) + 0.0 AS slope, round(sigma, 4) + 0.0 AS sigma, round(days_left, 3) + 0.0 AS days_left"
_prj = lambda s, d: _R(_R(T.project(readings(s, d)).drop("depletion"), "slope", "sigma", n=4), "days_left", n=3)
_add("attrition_scopes", lambda s, d: T.scopes(readings(s, d)), f"WITH {READINGS} SELECT DISTINCT category, side FROM rd")
_add("attrition_collapse", lambda s, d: T.collapse(readings(s, d)), _COL + " SELECT * FROM co")
_add("attrition_trajectory", lambda s, d: T.trajectory(readings(s, d)), _TRJ + " SELECT * FROM tr")
_add("attrition_ratio", lambda s, d: _R(T.attrition_ratio(readings(s, d), 30), "ratio"), _COL + ", bk AS (SELECT *, row_number() OVER (PARTITION BY category, side ORDER BY date DESC) AS b FROM co) SELECT category, side, sum(produced) AS produced, sum(lost) AS lost, round(sum(lost) / nullif(sum(produced), 0), 6) + 0.0 AS ratio, coalesce(sum(lost) / nullif(sum(produced), 0) <= 1, false) AS sustainable FROM bk WHERE b <= 30 GROUP BY 1, 2")
_add("attrition_projection", _prj, _PRJ + f" SELECT {_PJ_COLS} FROM pj")
_add("attrition_projected_days", lambda s, d: _R(T.projected_days(T.project(readings(s, d)), 14), "stock", "low", "high", n=2), _PRJ + " SELECT category, side, CAST(last + CAST(h AS INT) AS DATE) AS date, round(greatest(0, current + slope * h), 2) + 0.0 AS stock, round(greatest(0, current + slope * h - sigma), 2) + 0.0 AS low, round(greatest(0, current + slope * h + sigma), 2) + 0.0 AS high FROM pj, range(1, 15) r(h)")
_add("attrition_board", lambda s, d: T.board(_prj(s, d)), _PRJ + f" SELECT *, CAST(row_number() OVER (ORDER BY days_left NULLS LAST, category, side) AS INT) AS rank FROM (SELECT {_PJ_COLS} FROM pj)")
_add("attrition_balance", lambda s, d: _R(T.balance(readings(s, d), "F", "O"), "ratio"), _TRJ + ", nw AS (SELECT category, side, arg_max(stock, date) AS stock FROM tr GROUP BY 1, 2) SELECT a.category, a.stock AS left_stock, b.stock AS right_stock, round(a.stock / nullif(b.stock, 0), 6) + 0.0 AS ratio FROM (SELECT * FROM nw WHERE side = 'F') a FULL JOIN (SELECT * FROM nw WHERE side = 'O') b ON a.category = b.category")
_add("attrition_summary", lambda s, d: T.summary(readings(s, d)), _COL + " SELECT category, count(DISTINCT side) AS sides, count(*) AS days, sum(produced) AS produced, sum(lost) AS lost FROM co GROUP BY 1")

# Boards of the dense series -----------------------------------------------------------------------------------------
_BOARD = CORE["tempo_board"]
_board = lambda s, d: _R(S.tempo_board(ev_orders(s, d), "country"), "slope", "projected")
_add("tempo_summary", lambda s, d: S.tempo_summary(_board(s, d)), f"""WITH tb AS ({_BOARD}) SELECT count(*) AS keys, count(*) FILTER (WHERE trend = 'rising') AS rising, count(*) FILTER (WHERE trend = 'steady') AS steady, count(*) FILTER (WHERE trend = 'falling') AS falling, round(sum(projected), 3) AS projected_total,
coalesce((SELECT string_agg(country, ',' ORDER BY slope DESC, projected DESC, country) FROM (SELECT * FROM tb WHERE trend = 'rising' ORDER BY slope DESC, projected DESC, country LIMIT 5)), '') AS top_rising FROM tb""")
_sat = lambda c, w: f"round(({_SAT(c)}) * {w}::DOUBLE, 6)"
_add("escalation_now", lambda s, d: _R(S.escalation_now(S.escalation_index(ev_stream(s, d))), "index", "slope_per_day"), f"WITH {EV_STREAM} " + _ESC.replace("{ev}", "evs") + f""", tl AS (SELECT *, row_number() OVER (ORDER BY i DESC) AS b FROM dl), ls AS (SELECT * FROM tl WHERE b = 1),
sl AS (SELECT regr_slope(ind, i) AS slope FROM tl WHERE b <= 7), dr AS (SELECT string_agg(name, ',' ORDER BY v DESC, name) AS drivers FROM (SELECT unnest(['tempo', 'intensity', 'spread']) AS name, unnest([{_sat('t', 0.4)}, {_sat('n', 0.35)}, {_sat('p', 0.25)}]) AS v FROM ls))
SELECT date, round(ind, 6) + 0.0 AS index, CASE WHEN ind >= 80 THEN 'severe' WHEN ind >= 60 THEN 'high' WHEN ind >= 40 THEN 'elevated' WHEN ind >= 20 THEN 'guarded' ELSE 'calm' END AS level, CASE WHEN delta >= 5 THEN 'rising' WHEN delta <= -5 THEN 'falling' ELSE 'steady' END AS direction, round(slope, 6) + 0.0 AS slope_per_day, drivers FROM ls, sl, dr""")

# Harvest and catalogs: pages as a catalog of sources ------------------------------------------------------------------
_CAT = "ct AS (SELECT page_id AS seq, concat('source ', CAST(page_id % 40 AS STRING)) AS name, url, CASE page_id % 4 WHEN 0 THEN 'tracker' WHEN 1 THEN 'dataset' WHEN 2 THEN 'tool' ELSE 'news' END AS type, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS rss FROM pages)"


def _catalog(s, d):
    return _table(s, d, "pages").selectExpr("page_id AS seq", "concat('source ', CAST(page_id % 40 AS STRING)) AS name", "url", "CASE page_id % 4 WHEN 0 THEN 'tracker' WHEN 1 THEN 'dataset' WHEN 2 THEN 'tool' ELSE 'news' END AS type", "CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS rss")


_VOCAB = ["alpha", "beta", "gamma", "delta"]
_PAR = f"WITH {_CAT}, ps AS (SELECT name, arg_min(url, seq) AS url, min(seq) AS seq FROM ct WHERE type IN ('tracker', 'dataset', 'tool') AND starts_with(url, 'http') GROUP BY name)"
_EXP = _PAR + ", vo AS (SELECT unnest(range(5)) AS i, unnest([NULL, 'alpha', 'beta', 'gamma', 'delta']) AS term), ep AS (SELECT seq * 5 + i AS seq, name AS source, concat(name, CASE WHEN term IS NULL THEN ':_all' ELSE ':q=' || term END) AS key, url || CASE WHEN term IS NULL THEN '' ELSE CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'q=' || term END AS url FROM ps, vo)"
_ends = lambda s, d: H.expand(H.parametric_sources(_catalog(s, d)), _VOCAB)
_add("parametric_sources", lambda s, d: H.parametric_sources(_catalog(s, d)), _PAR + " SELECT * FROM ps")
_add("endpoint_expansion", _ends, _EXP + " SELECT * FROM ep")
# Fetches of the log table: sources are users, records their amounts.
_FET = "SELECT concat('source ', CAST(user_id % 40 AS STRING)) AS source, CAST(event_id AS DOUBLE) AS fetched_at, CAST(event_id % 12 AS BIGINT) AS records, CAST(event_id % 12 // 2 AS BIGINT) AS new_records, CASE WHEN event_type = 'error' THEN 1::BIGINT ELSE 0::BIGINT END AS errors FROM events"
_fetches = lambda s, d: _table(s, d, "events").selectExpr("concat('source ', CAST(user_id % 40 AS STRING)) AS source", "CAST(event_id AS DOUBLE) AS fetched_at", "CAST(event_id % 12 AS BIGINT) AS records", "CAST(event_id % 12 div 2 AS BIGINT) AS new_records", "CASE WHEN event_type = 'error' THEN 1L ELSE 0L END AS errors")
_STA = f"SELECT source, count(*) AS fetches, CAST(sum(records) AS BIGINT) AS records, CAST(sum(new_records) AS BIGINT) AS new_records, CAST(sum(errors) AS BIGINT) AS errors, max(fetched_at) AS last_fetch_at, round(greatest(0.0, least(1.0, sum(records)::DOUBLE / count(*) / 10) * (1 - sum(errors)::DOUBLE / count(*)) * (0.5::DOUBLE + 0.5::DOUBLE * (sum(new_records) / (sum(records) + 1.0::DOUBLE)))), 6) AS reliability FROM ({_FET}) GROUP BY 1"
_add("source_stats", lambda s, d: H.source_stats(_fetches(s, d)), _STA)
_add("endpoint_priority", lambda s, d: H.prioritized(_ends(s, d), H.source_stats(_fetches(s, d)), 25).select("key", "reliability"), _EXP + f", st AS ({_STA}) SELECT key, coalesce(reliability, 1.0) AS reliability FROM ep LEFT JOIN st ON ep.source = st.source ORDER BY 2 DESC, ep.seq LIMIT 25")


def _grown(s, d):
    engine = H.Harvest(s)
    engine.add_endpoints(_ends(s, d))
    engine.grow(2, 0.0, 1.0)
    return engine.store.groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("uid").alias("uids"))


_add("harvest_cycles", _grown, _EXP + " SELECT source, count(*) * 6 AS records, count(*) * 6 AS uids FROM ep GROUP BY 1")
_add("catalog_facets", lambda s, d: K.facets(_catalog(s, d), "type", "name"), f"WITH {_CAT} SELECT 'type' AS facet, type AS value, count(*) AS n FROM ct GROUP BY 1, 2 UNION ALL SELECT 'name', name, count(*) FROM ct GROUP BY 1, 2")
_add("catalog_search", lambda s, d: K.search_fields(_catalog(s, d), keyword="EXAMPLE.ORG", contains={"url": "/en/"}, type="Tool").select("seq", "url"), f"WITH {_CAT} SELECT seq, url FROM ct WHERE type = 'tool' AND contains(lower(url), '/en/') AND contains(lower(concat_ws(' ', name, url, type, rss)), 'example.org')")
_add("catalog_feeds", lambda s, d: K.feeds(_catalog(s, d)), f"WITH {_CAT} SELECT name, rss AS feed FROM ct WHERE rss <> ''")
_add("catalog_one_per_site", lambda s, d: K.one_per_site(_catalog(s, d)).select("seq", "url"), f"WITH {_CAT}, h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/$', '') AS site FROM ct) SELECT seq, url FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) AS r FROM h) WHERE r = 1")

# Logs and inventories -------------------------------------------------------------------------------------------------
_add("log_replay", lambda s, d: L.replay(log(s, d), "click", 100.0, 2000.0).select("seq", "t", "channel"), f"WITH {LOG} SELECT seq, t, channel FROM lg WHERE channel = 'click' AND t BETWEEN 100 AND 2000")
_add("log_after_action", lambda s, d: L.after_action(log(s, d)), f"WITH {LOG} SELECT channel, count(*) AS records, min(t) AS start_t, max(t) AS end_t, max(t) - min(t) AS duration_s FROM lg GROUP BY ROLLUP (channel)")
_RIDE = f"""WITH {LOG}, jk AS (SELECT *, coalesce(abs(accel - lag(accel) OVER w) / greatest(1e-6::DOUBLE, t - lag(t) OVER w), 0.0) AS jerk FROM lg WINDOW w AS (PARTITION BY vehicle ORDER BY t)),
ra AS (SELECT *, [abs(accel) / 1.2::DOUBLE, abs("lateral") / 1.2::DOUBLE, jerk / 1.0::DOUBLE, abs(tilt) / 12.0::DOUBLE, abs(speed) / 6.0::DOUBLE] AS r FROM jk), wo AS (SELECT *, list_max(r) AS worst FROM ra),
rv AS (SELECT vehicle, t, jerk, CASE WHEN worst > 0 THEN ['accel', 'lateral', 'jerk', 'tilt', 'speed'][list_position(r, worst)] END AS worst_axis, worst AS worst_ratio, CASE WHEN worst <= 1 THEN 'ok' WHEN worst <= 1.25 THEN 'minor' WHEN worst <= 1.6 THEN 'moderate' ELSE 'severe' END AS severity, 1 / (1 + pow(greatest(0.0, worst - 1), 2)) AS quality FROM wo)"""
_add("ride_verdicts", lambda s, d: _R(L.ride_verdicts(log(s, d)), "jerk", "worst_ratio", "quality"), _RIDE + " SELECT vehicle, t, round(jerk, 6) + 0.0 AS jerk, worst_axis, round(worst_ratio, 6) + 0.0 AS worst_ratio, severity, round(quality, 6) + 0.0 AS quality FROM rv")
_add("ride_report", lambda s, d: _R(L.ride_report(L.ride_verdicts(log(s, d))), "ride_quality"), _RIDE + " SELECT vehicle, count(*) AS samples, round(avg(quality), 6) + 0.0 AS ride_quality, count(*) FILTER (WHERE severity = 'minor') AS minor, count(*) FILTER (WHERE severity = 'moderate') AS moderate, count(*) FILTER (WHERE severity = 'severe') AS severe, count(*) FILTER (WHERE severity IN ('moderate', 'severe')) = 0 AS acceptable FROM rv GROUP BY 1")
_STOCK = ["concat('part ', CAST(p_partkey AS STRING)) AS item", "CAST(p_size % 9 AS DOUBLE) AS days_on_hand", "CAST(p_partkey % 4 AS DOUBLE) / 2 AS burn", "CAST(2 AS DOUBLE) AS trigger_days", "CAST(1 AS DOUBLE) AS critical_days"]
_add("stock_status", lambda s, d: _R(L.stock_status(_table(s, d, "part").selectExpr(*_STOCK)), "effective_days", "days_to_trigger"), f"WITH st AS (SELECT {', '.join(_STOCK)} FROM part), e AS (SELECT *, CASE WHEN burn > 0 THEN days_on_hand / burn END AS ed, CASE WHEN burn > 0 THEN greatest(0.0, (days_on_hand - trigger_days) / burn) END AS dt FROM st) SELECT item, days_on_hand, round(ed, 6) AS effective_days, CASE WHEN ed <= 0 THEN 'black' WHEN ed <= critical_days THEN 'critical' WHEN ed <= trigger_days THEN 'reorder' ELSE 'green' END AS status, round(dt, 6) AS days_to_trigger, coalesce(dt <= 7, false) AS triggers, coalesce(ed <= 7, false) AS runs_out FROM e")
_UNITS = ["s_name AS unit", "CAST(s_suppkey % 50 AS INT) AS strength", "CAST(s_nationkey % 5 AS DOUBLE) / 2 AS days"]
_add("supply_requirement", lambda s, d: _R(L.requirement(_table(s, d, "supplier").selectExpr(*_UNITS)), "weight", "volume"), f"WITH un AS (SELECT {', '.join(_UNITS)} FROM supplier), pf(item, w, v) AS (VALUES " + ", ".join(f"('{c}', {w}::DOUBLE, {v}::DOUBLE)" for c, (w, v) in L.PER_PERSON_DAY.items()) + ") SELECT unit, item, CAST(ceil(strength * days) AS BIGINT) AS person_days, round(ceil(strength * days) * w, 6) AS weight, round(ceil(strength * days) * v, 6) AS volume FROM un, pf")
_PLACED = ["concat('v', CAST(l_suppkey % 50 AS STRING)) AS vehicle", "CAST(l_linenumber AS DOUBLE) - 4 AS station", "CAST(l_quantity AS DOUBLE) AS weight", "CAST(l_linenumber AS DOUBLE) AS volume"]
_add("load_rollup", lambda s, d: _R(L.load_rollup(_table(s, d, "lineitem").selectExpr(*_PLACED)), "cg"), f"WITH pl AS (SELECT {', '.join(_PLACED)} FROM lineitem) SELECT vehicle, count(*) AS lines, sum(weight) AS weight, sum(volume) AS volume, round(CASE WHEN sum(weight) > 0 THEN sum(weight * station) / sum(weight) ELSE 0 END, 6) + 0.0 AS cg FROM pl GROUP BY 1")
_add("load_packing", lambda s, d: L.pack(_table(s, d, "lineitem").selectExpr("concat('o', CAST(l_orderkey AS STRING)) AS vehicle", "concat('i', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS item", "CAST(l_quantity AS DOUBLE) AS weight", "CAST(l_linenumber AS DOUBLE) AS volume"), [(80.0, 20.0), (40.0, 10.0)]))
_PARTS = ["p_name AS name", "CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS version", "p_brand AS origin", "p_type AS license"]
_RULES = {"origins": ("Brand#11", "brand#2"), "licenses": ("promo",), "denied": ("small ring",), "pinned": False}
_FND = f"WITH pa AS (SELECT {', '.join(_PARTS)} FROM part), fi AS (SELECT name AS component, 'prohibited_origin' AS rule, true AS blocking FROM pa WHERE lower(origin) IN ('brand#11', 'brand#2') UNION ALL SELECT name, 'disallowed_license', true FROM pa WHERE lower(license) = 'promo' UNION ALL SELECT name, 'denylisted', true FROM pa WHERE lower(name) = 'small ring' UNION ALL SELECT name, 'unpinned_version', false FROM pa WHERE version = '')"
_add("component_findings", lambda s, d: L.component_findings(_table(s, d, "part").selectExpr(*_PARTS), **_RULES), _FND + " SELECT * FROM fi")
_add("component_gate", lambda s, d: L.gate(_table(s, d, "part").selectExpr(*_PARTS), **_RULES).drop("digest"), _FND + " SELECT (SELECT count(*) FROM pa) AS components, count(*) FILTER (WHERE blocking) AS blocking, count(*) FILTER (WHERE NOT blocking) AS advisory, count(*) FILTER (WHERE blocking) = 0 AS admit FROM fi")
_LIT = ["concat('v', CAST(c_custkey % 300 AS STRING)) AS vehicle", "CASE c_custkey % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'fault' WHEN 2 THEN 'loaded' ELSE 'secured' END AS state"]
_add("litter_occupancy", lambda s, d: L.occupancy(_table(s, d, "customer").selectExpr(*_LIT)), f"WITH li AS (SELECT {', '.join(_LIT)} FROM customer), oc AS (SELECT vehicle, count(*) AS positions, count(*) FILTER (WHERE state IN ('loaded', 'secured')) AS loaded, count(*) FILTER (WHERE state = 'secured') AS secured, count(*) FILTER (WHERE state = 'fault') AS faults FROM li GROUP BY 1) SELECT *, loaded >= 2 AND faults = 0 AS enough, loaded = secured AND loaded > 0 AS all_secured FROM oc")
