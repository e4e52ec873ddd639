"""Registered queries of the event operators over the bridge views, each with its DuckDB SQL.

The oracle is written from the operators' definitions, not from their plans: where Spark expands calendars or blocks
joins, the SQL compares rows with rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.fixed import ADVISORIES
from ..operators import aggregates as A
from ..operators import detect as D
from ..operators import series as S
from .bridge import EV_ORDERS, EV_STREAM, ev_orders, ev_stream

Q, O = {}, {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql:
        O[name] = sql


def _both(name, query, sql):
    """The same query over both views; ``sql`` uses {ev} for the view."""
    _add(name, lambda s, d: query(ev_orders(s, d)), f"WITH {EV_ORDERS} " + sql.replace("{ev}", "evo"))
    _add(f"{name}_stream", lambda s, d: query(ev_stream(s, d)), f"WITH {EV_STREAM} " + sql.replace("{ev}", "evs"))


_SUMS = "count(*) AS events, CAST(sum(magnitude) AS BIGINT) AS magnitude"
_PLACE = "coalesce(nullif(trim(location), ''), nullif(trim(region), ''), nullif(trim(country), ''))"
_SEV = "CASE WHEN magnitude >= 25 OR (event_type = 'explosion/remote' AND magnitude >= 10) THEN 'critical' WHEN magnitude >= 5 THEN 'high' WHEN magnitude >= 1 THEN 'medium' WHEN event_type IN ('battle', 'explosion/remote', 'drone/uas') THEN 'low' ELSE 'info' END"

_both("hotspots", lambda e: A.hotspots(e, 10), f"SELECT country, coalesce(nullif(trim(region), ''), nullif(trim(location), ''), '') AS place, {_SUMS} FROM {{ev}} GROUP BY 1, 2 ORDER BY magnitude DESC, events DESC, country, place LIMIT 10")
_both("timeline", A.timeline, f"SELECT date, {_SUMS} FROM {{ev}} WHERE date IS NOT NULL GROUP BY date")
_both("actor_activity", lambda e: A.actor_activity(e, 10), f"SELECT actor, {_SUMS} FROM (SELECT actor1 AS actor, magnitude FROM {{ev}} UNION ALL SELECT actor2, magnitude FROM {{ev}}) WHERE coalesce(actor, '') <> '' GROUP BY actor ORDER BY events DESC, actor LIMIT 10")
_both("type_mix", A.by_type, "SELECT event_type, count(*) AS events FROM {ev} GROUP BY event_type")
_both("severity_mix", A.severity_mix, f"SELECT {_SEV} AS severity, count(*) AS events FROM {{ev}} GROUP BY 1")
_TREND = """, m AS (SELECT max(date) AS last FROM {ev}), c AS (SELECT last, count(*) FILTER (WHERE last - date < 30) AS recent, count(*) FILTER (WHERE last - date >= 30 AND last - date < 60) AS prior FROM {ev}, m GROUP BY last)"""
_TREND_COLS = "last, recent, prior, CASE WHEN prior > 0 THEN 100.0::DOUBLE * (recent - prior) / prior WHEN recent > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS pct_change, recent > prior AS escalating"
_both("trend", lambda e: A.trend(e, 30), _TREND + f" SELECT {_TREND_COLS} FROM c")
_both("summary", lambda e: A.summary(e, 30), _TREND + f", t AS (SELECT {_SUMS}, min(date) AS first, count(DISTINCT country) AS countries, count(DISTINCT event_type) AS types, count(DISTINCT actor1) AS actors FROM {{ev}}) SELECT t.*, {_TREND_COLS} FROM t, c")
_both("dedupe", lambda e: A.dedupe(e.withColumn("id", F.sha1(F.concat_ws("|", F.col("date").cast("string"), "event_type", "country", "location"))), "id").select("id", "seq", "magnitude"), "SELECT id, seq, magnitude FROM (SELECT sha1(concat_ws('|', CAST(date AS STRING), event_type, country, location)) AS id, seq, magnitude, row_number() OVER (PARTITION BY date, event_type, country, location ORDER BY seq) AS r FROM {ev}) WHERE r = 1")
_both("grouping_cube", A.grouping_cube, f"SELECT region, event_type, {_SUMS}, CAST(grouping(region, event_type) AS BIGINT) AS level FROM {{ev}} GROUP BY CUBE (region, event_type)")
_both("coordinated_days", lambda e: A.coordinated_days(e, 3), f"SELECT date, count(DISTINCT coalesce(nullif(trim(region), ''), country)) AS places, {_SUMS}, array_to_string(list_sort(list_distinct(list(coalesce(nullif(trim(region), ''), country)))), ',') AS place_list FROM {{ev}} GROUP BY date HAVING count(DISTINCT coalesce(nullif(trim(region), ''), country)) >= 3")
_NODES = "SELECT actor, {sums} FROM (SELECT trim(actor1) AS actor, magnitude FROM {ev} UNION ALL SELECT trim(actor2), magnitude FROM {ev} WHERE trim(actor2) <> trim(actor1)) WHERE actor <> '' GROUP BY actor".replace("{sums}", _SUMS)
_EDGES = "SELECT least(trim(actor1), trim(actor2)) AS a, greatest(trim(actor1), trim(actor2)) AS b, count(*) AS weight, CAST(sum(magnitude) AS BIGINT) AS magnitude FROM {ev} WHERE trim(actor1) <> trim(actor2) AND trim(actor1) <> '' AND trim(actor2) <> '' GROUP BY 1, 2"
_both("actor_nodes", A.actor_nodes, _NODES)
_both("actor_edges", A.actor_edges, _EDGES)
_both("cooccurrence", lambda e: A.cooccurrence(e, 3, 2), f""", p AS (SELECT date, event_type, {_PLACE} AS place FROM {{ev}})
SELECT least(x.event_type, y.event_type) AS type_a, greatest(x.event_type, y.event_type) AS type_b, count(*) AS pairs, count(DISTINCT x.place) AS places FROM p x JOIN p y ON x.place = y.place AND y.date - x.date BETWEEN 0 AND 3 AND x.event_type <> y.event_type
AND (x.date < y.date OR x.event_type < y.event_type) GROUP BY 1, 2 HAVING count(*) >= 2""")

# Dense series -------------------------------------------------------------------------------------------------------
_DAYS = """, b AS (SELECT min(date) AS lo, max(date) AS hi FROM {ev}), cal AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date, lo FROM b),
s AS (SELECT cal.date, CAST(cal.date - cal.lo AS INT) AS i, count(e.seq) AS events, CAST(coalesce(sum(e.magnitude), 0) AS BIGINT) AS magnitude FROM cal LEFT JOIN {ev} e ON e.date = cal.date GROUP BY cal.date, cal.lo)"""
_both("daily_series", S.dense_daily, _DAYS + " SELECT * FROM s")
_both("moving_average", lambda e: S.moving_average(S.dense_daily(e), 7), _DAYS + " SELECT *, sum(events) OVER w::DOUBLE / count(*) OVER w AS average FROM s WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)".replace("sum(events) OVER w::DOUBLE", "CAST(sum(events) OVER w AS DOUBLE)"))
_both("window_totals", lambda e: S.window_totals(S.dense_daily(e), 7), _DAYS + " SELECT CAST((m.hi - s.date) // 7 AS INT) AS k, CAST(sum(events) AS BIGINT) AS total FROM s, (SELECT max(date) AS hi FROM s) m GROUP BY 1 HAVING count(*) = 7")
_both("weekday_profile", lambda e: S.weekday_profile(S.dense_daily(e)), _DAYS + " SELECT CAST(w AS INT) AS weekday, CAST(coalesce(sum(events), 0) AS BIGINT) AS total, count(s.date) AS days, CASE WHEN count(s.date) > 0 THEN CAST(sum(events) AS DOUBLE) / count(s.date) ELSE 0.0 END AS mean FROM range(7) r(w) LEFT JOIN s ON isodow(s.date) - 1 = w GROUP BY w")
_Z = "CASE WHEN mad > 0 THEN (v - median) / (1.4826::DOUBLE * mad) WHEN v <= median THEN 0.0 ELSE 3.0::DOUBLE * (v - median) / greatest(median, 1.0) END"
_both("peaks", lambda e: S.peaks(S.dense_daily(e), min_z=1.5), _DAYS + f", d AS (SELECT median(events::DOUBLE) AS median FROM s), a AS (SELECT median(abs(events - median)) AS mad FROM s, d), z AS (SELECT date, events AS v, median, mad FROM s, d, a) SELECT date, v AS value, median, mad, {_Z} AS z FROM z WHERE {_Z} >= 1.5 AND v >= 3 AND v > median")
_LULLS = ", g AS (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INT) AS island FROM s WHERE events <= {quiet}) SELECT min(date) AS start, max(date) AS \"end\", count(*) AS days FROM g GROUP BY island HAVING count(*) >= 2"
_add("lulls", lambda s, d: S.lulls(S.dense_daily(ev_orders(s, d).where("magnitude >= 8")), quiet=0, min_run=2), f"WITH {EV_ORDERS}, q AS (SELECT * FROM evo WHERE magnitude >= 8)" + _DAYS.replace("{ev}", "q") + _LULLS.replace("{quiet}", "0"))
_add("lulls_stream", lambda s, d: S.lulls(S.dense_daily(ev_stream(s, d)), quiet=335, min_run=2), f"WITH {EV_STREAM}" + _DAYS.replace("{ev}", "evs") + _LULLS.replace("{quiet}", "335"))
_both("forecast", lambda e: S.forecast(S.dense_daily(e), horizon=7, fit_days=28), _DAYS + """, f AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS back FROM s), t AS (SELECT *, count(*) OVER () - back AS x FROM f WHERE back <= 28),
l AS (SELECT count(*) AS n, max(date) AS last, sum(x) AS sx, sum(events) AS sy, sum(x * x) AS sxx, sum(x * events) AS sxy FROM t),
c AS (SELECT n, last, sx, sy, CASE WHEN n * sxx - sx * sx <> 0 THEN CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) ELSE 0.0 END AS slope FROM l)
SELECT CAST(last + CAST(h AS INT) AS DATE) AS date, greatest(0.0, (sy - slope * sx) / n + slope * (n - 1 + h)) AS value, slope, CASE WHEN slope > 0.05 THEN 'rising' WHEN slope < -0.05 THEN 'falling' ELSE 'flat' END AS direction FROM c, range(1, 8) r(h)""")
_R = lambda df, *cols: df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])
_both("tempo_board", lambda e: _R(S.tempo_board(e, "country"), "recent", "prior", "momentum", "slope", "sigma", "projected"), """, e AS (SELECT * FROM {ev} WHERE coalesce(trim(country), '') <> '' AND date IS NOT NULL), hi AS (SELECT max(date) AS hi FROM e),
b AS (SELECT country, min(date) AS lo FROM e GROUP BY country), cal AS (SELECT country, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM b, hi),
n AS (SELECT country, date, count(*) AS c FROM e GROUP BY 1, 2), s AS (SELECT cal.country, cal.date, coalesce(n.c, 0) AS events FROM cal LEFT JOIN n ON n.country = cal.country AND n.date = cal.date),
k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY country) AS days FROM s),
x AS (SELECT *, least(28, days) - back AS x FROM k WHERE days >= 3),
g AS (SELECT country, max(date) AS last, max(days) AS days, CAST(sum(events) AS BIGINT) AS total, avg(events) FILTER (WHERE back <= 7) AS recent, avg(events) FILTER (WHERE back BETWEEN 8 AND 14) AS prior,
count(*) FILTER (WHERE back <= 28) AS k, regr_slope(events, x) FILTER (WHERE back <= 28) AS sl, regr_intercept(events, x) FILTER (WHERE back <= 28) AS ic, regr_syy(events, x) FILTER (WHERE back <= 28) AS syy, regr_sxy(events, x) FILTER (WHERE back <= 28) AS sxy FROM x GROUP BY country)
SELECT country, last, days, total, round(recent, 6) AS recent, round(prior, 6) AS prior, round(recent - prior, 6) AS momentum, round(sl, 6) + 0.0 AS slope, round(sqrt(greatest(0.0, (syy - sl * sxy) / k)), 6) AS sigma,
round((SELECT sum(greatest(0.0, ic + sl * (k - 1 + h))) FROM range(1, 8) r(h)), 6) AS projected, CASE WHEN sl > 0.1 THEN 'rising' WHEN sl < -0.1 THEN 'falling' ELSE 'steady' END AS trend FROM g""")
_SAT = lambda x: f"CASE WHEN {x} <= 1 THEN 0.0 ELSE 100 * (1 - exp(-({x} - 1) / 1.5)) END"
_ESC = _DAYS + f""", pl AS (SELECT DISTINCT date, {_PLACE} AS place FROM {{ev}}),
fp AS (SELECT s.date, s.i, count(DISTINCT place) AS fp FROM s LEFT JOIN pl ON pl.date BETWEEN s.date - 6 AND s.date GROUP BY s.date, s.i),
pt AS (SELECT s.date, s.i, (SELECT sum(events) FROM s r WHERE r.i BETWEEN s.i - 6 AND s.i) AS recent, (SELECT sum(magnitude) FROM s r WHERE r.i BETWEEN s.i - 6 AND s.i) AS mag, (SELECT fp FROM fp WHERE fp.i = s.i) AS spread,
(SELECT sum(events) FROM s r WHERE r.i BETWEEN s.i - 34 AND s.i - 7) AS base, (SELECT sum(magnitude) FROM s r WHERE r.i BETWEEN s.i - 34 AND s.i - 7) AS bmag,
(SELECT avg(fp) FROM fp r WHERE r.i BETWEEN s.i - 28 AND s.i - 7 AND r.i >= 6) AS bsp, least(28, s.i - 6) AS nb FROM s WHERE s.i >= 13),
ra AS (SELECT *, recent / greatest(base * 7.0::DOUBLE / nb, 1.0) AS t, CASE WHEN mag = 0 THEN 0.0 ELSE (mag::DOUBLE / greatest(recent, 1)) / greatest(CASE WHEN base > 0 THEN bmag::DOUBLE / base ELSE 0.0 END, 0.5) END AS n, spread / greatest(bsp, 1.0) AS p FROM pt),
ix AS (SELECT *, (0.4::DOUBLE * ({_SAT('t')}) + 0.35::DOUBLE * ({_SAT('n')}) + 0.25::DOUBLE * ({_SAT('p')})) * least(1.0, recent / 6.0::DOUBLE) AS ind FROM ra),
dl AS (SELECT *, ind - lag(ind, 7) OVER (ORDER BY i) AS delta FROM ix)"""
_esc = lambda e: S.escalation_index(e, 7, 4)
_add("escalation_series", lambda s, d: _R(_esc(ev_stream(s, d)), "tempo_ratio", "intensity_ratio", "spread_ratio", "index", "delta"), f"WITH {EV_STREAM} " + _ESC.replace("{ev}", "evs") + """ SELECT date, CAST(recent AS BIGINT) AS recent, CAST(mag AS BIGINT) AS recent_mag, spread, round(t, 6) AS tempo_ratio, round(n, 6) AS intensity_ratio, round(p, 6) AS spread_ratio, round(ind, 6) AS index,
CASE WHEN ind >= 80 THEN 'severe' WHEN ind >= 60 THEN 'high' WHEN ind >= 40 THEN 'elevated' WHEN ind >= 20 THEN 'guarded' ELSE 'calm' END AS level, round(delta, 6) AS delta, CASE WHEN delta >= 5 THEN 'rising' WHEN delta <= -5 THEN 'falling' ELSE 'steady' END AS direction FROM dl""")
_add("escalation_summary", lambda s, d: _R(S.escalation_summary(_R(_esc(ev_stream(s, d)), "index")), "current", "peak"), f"WITH {EV_STREAM} " + _ESC.replace("{ev}", "evs") + """, r AS (SELECT *, round(ind, 6) AS ri FROM dl) SELECT round(arg_max(ri, date), 6) AS current, arg_max(CASE WHEN ind >= 80 THEN 'severe' WHEN ind >= 60 THEN 'high' WHEN ind >= 40 THEN 'elevated' WHEN ind >= 20 THEN 'guarded' ELSE 'calm' END, date) AS level,
max(ri) AS peak, (SELECT date FROM r ORDER BY ri DESC, date LIMIT 1) AS peak_date, count(*) FILTER (WHERE delta >= 5) AS rising, count(*) FILTER (WHERE delta <= -5) AS falling FROM r""")

# Detectors ----------------------------------------------------------------------------------------------------------
_SCOPES = {"global": "'(all)'", "country": "country", "region": "concat(country, '/', region)", "location": "location"}


def _aged(ev, scope, w, k):
    return f", mx AS (SELECT max(date) AS ref FROM {ev}), g AS (SELECT {_SCOPES[scope]} AS scope, {_PLACE} AS place, e.*, CAST((ref - date) // {w} AS INT) AS k FROM {ev} e, mx WHERE (ref - date) // {w} <= {k})"


_CAP = "CASE WHEN volume < 3 THEN 1 WHEN volume < 8 THEN 2 WHEN volume < 20 THEN 3 ELSE 4 END"
_BY = "CASE WHEN score >= 4 THEN 4 WHEN score >= 3 THEN 3 WHEN score >= 2 THEN 2 WHEN score >= 1 THEN 1 ELSE 0 END"
_ALERTS = f"""SELECT scope, detector, ['info', 'low', 'medium', 'high', 'critical'][least({_BY}, {_CAP}) + 1] AS severity, round(score, 6) AS score, CAST(volume AS BIGINT) AS volume, evidence FROM """


def _volume_sql(k):
    base = ", ".join(f"count(*) FILTER (WHERE k = {i})::DOUBLE" for i in range(1, k + 1))
    return f""", v AS (SELECT scope, count(*) FILTER (WHERE k = 0) AS recent, count(*) FILTER (WHERE k = 1) AS prior, count(*) FILTER (WHERE k >= 1) AS bn, coalesce(sum(magnitude) FILTER (WHERE k = 0), 0) AS mag, coalesce(sum(magnitude) FILTER (WHERE k >= 1), 0) AS bm, [{base}] AS b FROM g GROUP BY scope),
v2 AS (SELECT *, list_median(b) AS median FROM v WHERE recent > 0), v3 AS (SELECT *, list_median(list_transform(b, lambda x: abs(x - median))) AS mad, recent::DOUBLE AS v FROM v2), v4 AS (SELECT *, {_Z} AS z, mag::DOUBLE / recent AS lph, bm::DOUBLE / greatest(bn, 1) AS bl FROM v3),
va AS (SELECT scope, 'spike' AS detector, z AS score, recent AS volume, format('recent={{}} prior={{}}', recent, prior) AS evidence FROM v4 WHERE z >= 2 AND recent >= 2
UNION ALL SELECT scope, 'sustained-trend', 1 + (recent::DOUBLE / prior - 1.5), recent, format('recent={{}} prior={{}}', recent, prior) FROM v4 WHERE prior >= 2 AND recent >= 1.5 * prior AND recent >= 4
UNION ALL SELECT scope, 'lethality-shift', greatest(1.0, 1 + (lph / greatest(bl, 0.5) - 2)), mag, format('magnitude={{}} events={{}}', mag, recent) FROM v4 WHERE recent >= 3 AND bn >= 3 AND lph >= 1 AND lph >= 2 * bl AND lph - bl >= 1)"""


_ACTOR_SQL = """, ac AS (SELECT scope, k, trim(actor1) AS actor FROM g WHERE trim(actor1) <> '' UNION ALL SELECT scope, k, trim(actor2) FROM g WHERE trim(actor2) <> '' AND trim(actor2) <> trim(actor1)),
nw AS (SELECT scope, actor, count(*) FILTER (WHERE k = 0) AS now FROM ac GROUP BY 1, 2 HAVING count(*) FILTER (WHERE k > 0) = 0 AND count(*) FILTER (WHERE k = 0) > 0),
aa AS (SELECT scope, 'new-actor' AS detector, 1 + 0.7::DOUBLE * least(3, count(*)) AS score, greatest(sum(now), count(*)) AS volume, array_to_string(list_sort(list(actor))[1:5], ',') AS evidence FROM nw WHERE scope IN (SELECT scope FROM g WHERE k > 0) GROUP BY scope)"""
_PLACE_SQL = """, pp AS (SELECT scope, place, count(*) FILTER (WHERE k = 0) AS now, count(*) FILTER (WHERE k = 1) AS last, count(*) FILTER (WHERE k > 0) AS base FROM g GROUP BY 1, 2),
gs AS (SELECT scope, count(*) FILTER (WHERE now > 0) AS recent, count(*) FILTER (WHERE last > 0) AS prior, sum(now) AS events FROM pp GROUP BY scope),
pa AS (SELECT scope, 'geo-spread' AS detector, 1 + 0.5::DOUBLE * (recent - prior) AS score, events AS volume, format('recent={} prior={}', recent, prior) AS evidence FROM gs WHERE prior >= 1 AND recent >= prior + 2 AND recent >= 3
UNION ALL SELECT scope, 'new-hotspot', greatest(1 + 0.3::DOUBLE * (now - 4), 1.5), now, place FROM pp WHERE now >= 4 AND now >= 3 * base AND base <= 1)"""


_ADVICE = " ".join(f"WHEN '{n}' THEN '{text}'" for n, text in ADVISORIES.items())


def _alerts(name, view, scope, w, k):
    ev, cte = ("evo", EV_ORDERS) if view is ev_orders else ("evs", EV_STREAM)
    aged = f"WITH {cte} " + _aged(ev, scope, w, k)
    full = aged + _volume_sql(k) + _ACTOR_SQL + _PLACE_SQL + ", al AS (SELECT * FROM va UNION ALL SELECT * FROM aa UNION ALL SELECT * FROM pa)"
    _add(f"alerts_volume_{name}", lambda s, d: _R(D.volume_alerts(D.scoped(view(s, d), scope, w, k), k), "score"), aged + _volume_sql(k) + " " + _ALERTS + "va")
    _add(f"alerts_actor_{name}", lambda s, d: _R(D.actor_alerts(D.scoped(view(s, d), scope, w, k)), "score"), aged + _ACTOR_SQL + " " + _ALERTS + "aa")
    _add(f"alerts_place_{name}", lambda s, d: _R(D.place_alerts(D.scoped(view(s, d), scope, w, k)), "score"), aged + _PLACE_SQL + " " + _ALERTS + "pa")
    ranked = f"SELECT *, row_number() OVER (ORDER BY list_position(['info', 'low', 'medium', 'high', 'critical'], severity) DESC, score DESC, scope, detector, evidence)::INT AS rank FROM ({_ALERTS} al)"
    _add(f"alerts_ranked_{name}", lambda s, d: D.ranked(_R(D.detect(view(s, d), scope, w, k), "score")), full + " " + ranked)
    _add(f"alert_counts_{name}", lambda s, d: D.alert_counts(D.detect(view(s, d), scope, w, k)), full + f" SELECT detector, severity, count(*) AS alerts FROM ({_ALERTS} al) GROUP BY 1, 2")
    clamp = lambda x: f"round(least(1.0, greatest(0.0, {x})), 3)"
    post = full + f""", wt AS (SELECT scope, max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.85 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.0 END)::DOUBLE AS worst FROM ({_ALERTS} al) GROUP BY scope),
po AS (SELECT scope, count(*) FILTER (WHERE k = 0) AS recent, count(*) FILTER (WHERE k > 0) AS base, coalesce(sum(magnitude) FILTER (WHERE k = 0), 0) AS mag, count(*) FILTER (WHERE k = 0 AND event_type IN ('drone/uas', 'explosion/remote')) AS th, count(DISTINCT place) FILTER (WHERE k = 0) AS places FROM g GROUP BY scope HAVING count(*) FILTER (WHERE k = 0) > 0),
f AS (SELECT po.scope, recent, CAST(mag AS BIGINT) AS mag, {clamp(f"CASE WHEN base = 0 THEN CASE WHEN recent >= 4 THEN 1.0 ELSE recent / 4.0 END ELSE (recent / (base / {k}.0::DOUBLE) - 1) / 2 END")} AS tempo, {clamp("mag::DOUBLE / recent / 5")} AS lethality, {clamp("coalesce(worst, 0.0)")} AS escalation, {clamp("th::DOUBLE / recent")} AS drone_uas, {clamp("(places - 1) / 5.0::DOUBLE")} AS spread FROM po LEFT JOIN wt ON po.scope = wt.scope),
fs AS (SELECT *, round(tempo * 0.2::DOUBLE + lethality * 0.25::DOUBLE + escalation * 0.3::DOUBLE + drone_uas * 0.15::DOUBLE + spread * 0.1::DOUBLE, 6) AS score FROM f),
ft AS (SELECT *, CASE WHEN score >= 0.75 THEN 'red' WHEN score >= 0.5 THEN 'amber' WHEN score >= 0.25 THEN 'guarded' ELSE 'green' END AS tier, array_to_string(list_transform(list_sort(list_filter([{{'s': -tempo, 'i': 0, 'n': 'tempo'}}, {{'s': -lethality, 'i': 1, 'n': 'lethality'}}, {{'s': -escalation, 'i': 2, 'n': 'escalation'}}, {{'s': -drone_uas, 'i': 3, 'n': 'drone_uas'}}, {{'s': -spread, 'i': 4, 'n': 'spread'}}], lambda x: x.s <= -0.34)), lambda x: x.n), ',') AS drivers FROM fs)"""
    _add(f"posture_{name}", lambda s, d: D.posture(view(s, d), scope, w, k).withColumn("advisories", F.array_join("advisories", " ")), post + f" SELECT *, array_to_string(list_transform(list_filter(string_split(drivers, ','), lambda x: x <> ''), lambda x: CASE x {_ADVICE} END), ' ') AS advisories FROM ft")
    _add(f"posture_counts_{name}", lambda s, d: D.posture_counts(D.posture(view(s, d), scope, w, k)), post + " SELECT tier, count(*) AS scopes FROM ft GROUP BY tier")


_alerts("orders_country", ev_orders, "country", 90, 4)
_alerts("stream_location", ev_stream, "location", 3, 4)

_add("scope_keys", lambda s, d: ev_stream(s, d).groupBy(*[X.scope_key(k).alias(f"by_{k}") for k in ("global", "country", "region", "location")]).agg(F.count("*").alias("events")), f"WITH {EV_STREAM} SELECT '(all)' AS by_global, country AS by_country, concat(country, '/', region) AS by_region, location AS by_location, count(*) AS events FROM evs GROUP BY ALL")
