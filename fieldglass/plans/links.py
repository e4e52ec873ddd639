"""Registered queries: clusters, merged incidents, actor graphs and their change over windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import REPORT_STOPWORDS
from ..operators import aggregates as A
from ..operators import flux as W
from ..operators import graph as G
from ..operators import link as L
from .bridge import EV_STREAM, ev_stream

Q, O = {}, {}


def _add(name, query, sql=None):
    Q[name] = lambda s, d: query(ev_stream(s, d))
    if sql:
        O[name] = f"WITH RECURSIVE {EV_STREAM} {sql}"


_R = lambda df, *cols: df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in cols else c for c in df.columns])
_KM = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0, power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"
# The view's latitudes are tenths of a degree, and the radii are under a tenth, so DuckDB may hash the latitude.
_PAIRS = ", pr AS (SELECT x.seq AS a, y.seq AS b FROM evs x JOIN evs y ON x.seq < y.seq AND abs(x.date - y.date) <= 3 AND round(x.lat * 10) = round(y.lat * 10) WHERE " + _KM.format(a="x.lat", b="x.lon", c="y.lat", d="y.lon") + " <= 8.0)"
_COMP = ", ed AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}), rc AS (SELECT a AS node, a AS m FROM ed UNION SELECT ed.a, rc.m FROM rc JOIN ed ON ed.b = rc.node AND rc.m < ed.a), cc AS (SELECT node, min(m) AS component FROM rc GROUP BY node)"

_add("near_pairs", lambda e: L.near_pairs(e, 8.0, 3), _PAIRS + " SELECT a, b FROM pr")
_add("event_components", lambda e: L.connected_components(L.near_links(e, 8.0, 3)), _PAIRS + _COMP.replace("{pairs}", "pr") + " SELECT node, component FROM cc WHERE node <> component")
_add("clusters", lambda e: _R(L.clusters(e, 8.0, 3, 3), "center_lat", "center_lon", "radius_km"), _PAIRS + _COMP.replace("{pairs}", "pr") + """, gt AS (SELECT component, e.* FROM cc JOIN evs e ON e.seq = cc.node),
ba AS (SELECT component, count(*) AS size, CAST(sum(magnitude) AS BIGINT) AS magnitude, min(date) AS start, max(date) AS "end", avg(lat) AS clat, avg(lon) AS clon, CAST(max(date) - min(date) + 1 AS INT) AS span_days FROM gt GROUP BY 1 HAVING count(*) >= 3),
aw AS (SELECT gt.component, max(""" + _KM.format(a="lat", b="lon", c="clat", d="clon") + """) AS km FROM gt JOIN ba USING (component) GROUP BY 1),
an AS (SELECT component, actor, count(*) AS n FROM (SELECT component, actor1 AS actor FROM gt UNION ALL SELECT component, actor2 FROM gt) GROUP BY 1, 2),
tp AS (SELECT component, array_to_string(list(actor ORDER BY r), ',') AS top_actors FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, actor) AS r FROM an) WHERE r <= 6 GROUP BY 1)
SELECT component, size, magnitude, start, "end", round(clat, 6) + 0.0 AS center_lat, round(clon, 6) + 0.0 AS center_lon, span_days, round(km, 6) + 0.0 AS radius_km, top_actors FROM ba JOIN aw USING (component) JOIN tp USING (component)""")

_TOK = "list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', notes, actor1, actor2, location, region)), '([a-z0-9]+)', 1), lambda w: length(w) >= 2 AND w NOT IN (" + ", ".join(f"'{w}'" for w in REPORT_STOPWORDS) + ")))"
_DUP = f", tk AS (SELECT *, {_TOK} AS t FROM evs), dp AS (SELECT x.seq AS a, y.seq AS b FROM tk x JOIN tk y ON x.seq < y.seq AND abs(x.date - y.date) <= 1 AND round(x.lat * 10) = round(y.lat * 10) WHERE " + _KM.format(a="x.lat", b="x.lon", c="y.lat", d="y.lon") + """ <= 5.0
AND (coalesce(len(list_intersect(x.t, y.t))::DOUBLE / nullif(len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)), 0), 0.0) >= 0.5 OR (x.event_type = y.event_type AND x.event_type <> 'other')))"""
_OPT = {"max_day_gap": 1, "radius_km": 5.0, "threshold": 0.5}
_INC = _DUP + _COMP.replace("{pairs}", "dp") + ", ic AS (SELECT evs.*, coalesce(component, seq) AS incident FROM evs LEFT JOIN cc ON cc.node = seq)"
_add("duplicate_pairs", lambda e: L.duplicate_pairs(e, **_OPT), _DUP + " SELECT a, b FROM dp")
_add("incident_groups", lambda e: L.incident_groups(e, **_OPT), _INC + " SELECT seq, incident FROM ic")
_LONG = lambda c: f"arg_max({c}, length({c}) * 1000000000000 - seq) AS {c}"
_MERGED = _INC + f""", kn AS (SELECT incident, event_type, count(*) AS n, min(seq) AS f FROM ic GROUP BY 1, 2),
kt AS (SELECT incident, arg_max(event_type, n * 1000000000000 - f) AS top, arg_max(event_type, n * 1000000000000 - f) FILTER (WHERE event_type <> 'other') AS special FROM kn GROUP BY 1),
fd AS (SELECT incident, count(*) AS reports, min(date) AS date, max(magnitude) AS magnitude, {", ".join(map(_LONG, ("actor1", "actor2", "country", "region", "location", "notes")))}, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon, array_to_string(list_sort(list_distinct(list(source))), ' | ') AS source FROM ic GROUP BY 1),
mg AS (SELECT fd.*, CASE WHEN top = 'other' AND special IS NOT NULL THEN special ELSE top END AS event_type FROM fd JOIN kt USING (incident))"""
_tagged = lambda e: e.withColumns({"id": F.concat(F.lit("e"), "seq"), "source_url": F.expr("CASE WHEN seq % 2 = 0 THEN concat('http://x/', seq) ELSE '' END"), "tags": F.expr("CASE seq % 3 WHEN 0 THEN array('armor', 'b:1') WHEN 1 THEN array('drone-uas') ELSE array() END")})
_add("merge", lambda e: L.merge(_tagged(e), **_OPT).withColumn("tags", F.array_join("tags", ",")), _MERGED + """, tg AS (SELECT incident, coalesce(min(CASE WHEN seq % 2 = 0 THEN concat('http://x/', seq) END), '') AS source_url, array_to_string(list_sort(list_distinct(list_concat(flatten(list(CASE seq % 3 WHEN 0 THEN ['armor', 'b:1'] WHEN 1 THEN ['drone-uas'] ELSE [] END)),
['merged:' || count(*)], CASE WHEN count(*) > 1 THEN list('src:e' || seq) ELSE [] END))), ',') AS tags FROM ic GROUP BY 1) SELECT mg.*, source_url, tags FROM mg JOIN tg USING (incident)""")
_add("merge_report", lambda e: L.merge_report(L.merge(e, **_OPT)), _MERGED + " SELECT CAST(sum(reports) AS BIGINT) AS reports, count(*) AS incidents, count(*) FILTER (WHERE reports > 1) AS merged, max(reports) AS largest FROM mg")

# Graphs: ties of at least eight events, so that the graph isn't complete ---------------------------------------------
_G = ", nd AS (SELECT DISTINCT actor FROM (SELECT actor1 AS actor FROM evs UNION ALL SELECT actor2 FROM evs)), ge AS (SELECT least(actor1, actor2) AS a, greatest(actor1, actor2) AS b, count(*) AS weight FROM evs WHERE actor1 <> actor2 GROUP BY 1, 2 HAVING count(*) >= 9), bw AS (SELECT a AS src, b AS dst, weight FROM ge UNION ALL SELECT b, a, weight FROM ge)"


def _graph(f):
    return lambda e: f(A.actor_nodes(e), A.actor_edges(e, 9))


_DEG = ", dg AS (SELECT actor, count(dst) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS strength FROM nd LEFT JOIN bw ON src = actor GROUP BY 1)"
_add("degree", _graph(G.degrees), _G + _DEG + " SELECT actor, degree, strength, CASE WHEN (SELECT count(*) FROM nd) > 1 THEN degree::DOUBLE / ((SELECT count(*) FROM nd) - 1) ELSE 0.0 END AS centrality FROM dg")
_GC = ", rc AS (SELECT actor AS node, actor AS m FROM nd UNION SELECT bw.src, rc.m FROM rc JOIN bw ON bw.dst = rc.node AND rc.m < bw.src)"
_add("graph_components", _graph(G.components), _G + _GC + " SELECT node AS actor, min(m) AS component FROM rc GROUP BY node")
_BFS = ", bf AS (SELECT actor AS s, actor AS t, 0 AS d FROM nd UNION SELECT bf.s, bw.dst, bf.d + 1 FROM bf JOIN bw ON bw.src = bf.t WHERE bf.d < 12), ds AS (SELECT s, t, min(d) AS d FROM bf GROUP BY 1, 2)"
_add("closeness", _graph(lambda n, e: _R(G.closeness(n, e), "score")), _G + _BFS + " SELECT s AS actor, round(CASE WHEN sum(d) > 0 THEN ((count(*) - 1) / sum(d)::DOUBLE) * ((count(*) - 1)::DOUBLE / ((SELECT count(*) FROM nd) - 1)) ELSE 0.0 END, 6) + 0.0 AS score FROM ds GROUP BY s")
_add("betweenness", _graph(lambda n, e: _R(G.betweenness(n, e), "score")), _G + _BFS + """, sg AS (SELECT s, t, d, CASE WHEN s = t THEN 1.0 ELSE 0.0 END::DOUBLE AS n0 FROM ds),
pc AS (SELECT s, t, 0 AS d, 1.0::DOUBLE AS n FROM ds WHERE s = t UNION ALL SELECT s, t, d, n FROM (SELECT pc.s, bw.dst AS t, pc.d + 1 AS d, sum(pc.n) OVER (PARTITION BY pc.s, bw.dst, pc.d) AS n, row_number() OVER (PARTITION BY pc.s, bw.dst, pc.d ORDER BY bw.src) AS k FROM pc JOIN bw ON bw.src = pc.t JOIN ds ON ds.s = pc.s AND ds.t = bw.dst AND ds.d = pc.d + 1) WHERE k = 1),
bt AS (SELECT v.t AS actor, sum(x.n * y.n / z.n) AS b FROM pc x JOIN ds v ON v.s = x.s AND v.t = x.t JOIN pc y ON y.s = x.t JOIN pc z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d WHERE x.s <> x.t AND y.s <> y.t AND x.s <> y.t GROUP BY 1)
SELECT actor, round(coalesce(b, 0.0) * 0.5 / (((SELECT count(*) FROM nd) - 1) * ((SELECT count(*) FROM nd) - 2) / 2), 6) + 0.0 AS score FROM nd LEFT JOIN bt USING (actor)""")
_add("closeness_weighted", _graph(lambda n, e: _R(G.closeness(n, e, weighted=True), "score")), _G + """, wp AS (SELECT 0 AS k, (SELECT list({'s': actor, 't': actor, 'd': 0.0::DOUBLE} ORDER BY actor) FROM nd) AS v UNION ALL
SELECT k + 1, (SELECT list({'s': s, 't': t, 'd': d} ORDER BY s, t) FROM (SELECT s, t, min(d) AS d FROM (SELECT s, t, d FROM (SELECT unnest(wp.v, recursive := true)) UNION ALL SELECT u.s, bw.dst, u.d + 1 / bw.weight::DOUBLE FROM (SELECT unnest(wp.v, recursive := true)) u JOIN bw ON bw.src = u.t) GROUP BY 1, 2)) FROM wp WHERE k < 30),
ds AS (SELECT unnest(v, recursive := true) FROM wp WHERE k = 30) SELECT s AS actor, round(CASE WHEN sum(d) > 0 THEN ((count(*) - 1) / sum(d)::DOUBLE) * ((count(*) - 1)::DOUBLE / ((SELECT count(*) FROM nd) - 1)) ELSE 0.0 END, 6) + 0.0 AS score FROM ds GROUP BY s""")
_add("betweenness_weighted", _graph(lambda n, e: _R(G.betweenness(n, e, weighted=True), "score")))
_add("pagerank", _graph(lambda n, e: _R(G.pagerank(n, e), "score")), _G + """, cnt AS (SELECT count(*)::DOUBLE AS n FROM nd), sh AS (SELECT src, dst, weight::DOUBLE / sum(weight) OVER (PARTITION BY src) AS p FROM bw),
rk AS (SELECT 0 AS k, (SELECT list({'actor': actor, 'score': 1.0::DOUBLE / n} ORDER BY actor) FROM nd, cnt) AS v UNION ALL
SELECT k + 1, (SELECT list({'actor': q.actor, 'score': 0.15::DOUBLE / n + 0.85::DOUBLE * (q.i + (1 - q.tot) / n)} ORDER BY q.actor) FROM (SELECT nd.actor, coalesce(m.i, 0.0) AS i, sum(coalesce(m.i, 0.0)) OVER () AS tot FROM nd LEFT JOIN (SELECT sh.dst, sum(sh.p * u.score) AS i FROM (SELECT unnest(rk.v, recursive := true)) u JOIN sh ON sh.src = u.actor GROUP BY 1) m ON m.dst = nd.actor) q, cnt) FROM rk WHERE k < 200)
SELECT actor, round(score, 6) + 0.0 AS score FROM (SELECT unnest(v, recursive := true) FROM rk WHERE k = 200)""")
_add("eigenvector", _graph(lambda n, e: _R(G.eigenvector(n, e), "score")), _G + """, rk AS (SELECT 0 AS k, (SELECT list({'actor': actor, 'score': 1.0::DOUBLE} ORDER BY actor) FROM nd) AS v UNION ALL
SELECT k + 1, (SELECT list({'actor': q.actor, 'score': CASE WHEN q.norm > 0 THEN q.i / q.norm ELSE 0.0 END} ORDER BY q.actor) FROM (SELECT nd.actor, coalesce(m.i, 0.0) AS i, sqrt(sum(coalesce(m.i, 0.0) * coalesce(m.i, 0.0)) OVER ()) AS norm FROM nd LEFT JOIN (SELECT bw.dst, sum(bw.weight * u.score) AS i FROM (SELECT unnest(rk.v, recursive := true)) u JOIN bw ON bw.src = u.actor GROUP BY 1) m ON m.dst = nd.actor) q) FROM rk WHERE k < 200)
SELECT actor, round(score, 6) + 0.0 AS score FROM (SELECT unnest(v, recursive := true) FROM rk WHERE k = 200)""")
# The coreness of an actor is the limit of: the largest k for which k neighbours have a value of k or more, from the degree on.
_add("coreness", _graph(G.coreness), _G + _DEG + """, rk AS (SELECT 0 AS k, (SELECT list({'actor': actor, 'c': degree} ORDER BY actor) FROM dg) AS v UNION ALL
SELECT k + 1, (SELECT list({'actor': q.actor, 'c': q.c} ORDER BY q.actor) FROM (SELECT actor, coalesce(max(least(c, r)), 0) AS c FROM (SELECT nd.actor, u.c, row_number() OVER (PARTITION BY nd.actor ORDER BY u.c DESC) AS r FROM nd JOIN bw ON bw.src = nd.actor JOIN (SELECT unnest(rk.v, recursive := true)) u ON u.actor = bw.dst) GROUP BY actor) q) FROM rk WHERE k < 60)
SELECT nd.actor, CAST(coalesce(c, 0) AS INT) AS core FROM nd LEFT JOIN (SELECT unnest(v, recursive := true) FROM rk WHERE k = 60) z ON z.actor = nd.actor""")
_add("communities", _graph(G.communities))
_add("graph_ranking", _graph(lambda n, e: G.ranking(n, e, "strength", 10)), _G + _DEG + " SELECT actor, strength::DOUBLE AS score FROM dg ORDER BY score DESC, actor LIMIT 10")
_add("graph_leaders", _graph(lambda n, e: G.leaders(n, e)), _G + _DEG + " SELECT count(*) AS actors, (SELECT count(*) FROM ge) AS ties, (SELECT actor FROM dg ORDER BY degree DESC, actor LIMIT 1) AS top_degree, (SELECT actor FROM dg ORDER BY strength DESC, actor LIMIT 1) AS top_strength FROM dg")

# Flux ---------------------------------------------------------------------------------------------------------------
_W = """, lo AS (SELECT min(date) AS lo FROM evs), wk AS (SELECT e.*, CAST((date - lo) // 5 AS INT) AS kk, lo FROM evs e, lo), wn AS (SELECT kk, CAST(row_number() OVER (ORDER BY kk) - 1 AS INT) AS w FROM (SELECT DISTINCT kk FROM wk)),
we AS (SELECT wk.*, w, CAST(lo + kk * 5 AS DATE) AS start FROM wk JOIN wn USING (kk)), ti AS (SELECT w, least(actor1, actor2) AS a, greatest(actor1, actor2) AS b, count(*) AS weight FROM we WHERE actor1 <> actor2 GROUP BY 1, 2, 3),
ac AS (SELECT w, actor, count(*) AS events FROM (SELECT w, actor1 AS actor FROM we UNION ALL SELECT w, actor2 FROM we WHERE actor2 <> actor1) GROUP BY 1, 2), wm AS (SELECT max(w) AS lw FROM we)"""
_placed = lambda f: lambda e: f(W.windows(e, 5))
_ST = ", st AS (SELECT we.w, start, count(*) AS events, max(o.n) AS \"order\", coalesce(max(t.n), 0) AS size FROM we LEFT JOIN (SELECT w, count(*) AS n FROM ac GROUP BY 1) o ON o.w = we.w LEFT JOIN (SELECT w, count(*) AS n FROM ti GROUP BY 1) t ON t.w = we.w GROUP BY 1, 2), sd AS (SELECT *, CASE WHEN \"order\" > 1 THEN size::DOUBLE / (\"order\" * (\"order\" - 1) / 2) ELSE 0.0 END AS density FROM st)"
_add("flux_structure", _placed(lambda p: _R(W.structure(p), "density")), _W + _ST + ' SELECT w, start, events, "order", size, round(density, 6) + 0.0 AS density FROM sd')
_add("flux_components", _placed(W.component_counts), _W + ", fc AS (SELECT w, actor AS node, actor AS m FROM ac UNION SELECT fc.w, x.a, fc.m FROM fc JOIN (SELECT w, a, b FROM ti UNION ALL SELECT w, b, a FROM ti) x ON x.w = fc.w AND x.b = fc.node AND fc.m < x.a) SELECT w, count(*) AS components FROM (SELECT w, node, min(m) AS c FROM fc GROUP BY 1, 2) WHERE node = c GROUP BY w")
_TR = _W + """, dg AS (SELECT w, actor, count(*) AS degree FROM (SELECT w, a AS actor FROM ti UNION ALL SELECT w, b FROM ti) GROUP BY 1, 2), gr AS (SELECT actor, i.w, coalesce(dg.degree, 0) AS degree FROM (SELECT DISTINCT actor FROM ac) CROSS JOIN wn i LEFT JOIN dg USING (actor, w)),
gs AS (SELECT actor, list(degree ORDER BY w) AS degrees, count(*) AS n, sum(w) AS sx, sum(degree) AS sy, sum(w * w) AS sxx, sum(w * degree) AS sxy FROM gr GROUP BY 1),
pk AS (SELECT actor, arg_max(w, coalesce(degree, 0) * 1000 + w) AS peak, min(w) AS first, max(w) AS last, CAST(sum(events) AS BIGINT) AS events FROM ac LEFT JOIN dg USING (w, actor) GROUP BY 1),
tj AS (SELECT actor, events, first, last, peak, array_to_string(degrees, ',') AS degrees, round(CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy)::DOUBLE / (n * sxx - sx * sx)::DOUBLE ELSE 0.0 END, 6) + 0.0 AS slope, CAST(n - 1 AS INT) AS last_window FROM gs JOIN pk USING (actor))"""
_path = lambda p: _R(W.trajectories(p).withColumn("degrees", F.array_join(F.transform("degrees", lambda x: x.cast("string")), ",")), "slope")
_add("flux_trajectories", _placed(_path), _TR + " SELECT * FROM tj")
_add("flux_rising", _placed(lambda p: W.rising(_path(p), 10)), _TR + " SELECT * FROM tj WHERE slope > 0 ORDER BY slope DESC, actor LIMIT 10")
_add("flux_fading", _placed(lambda p: W.fading(_path(p), 10)), _TR + " SELECT * FROM tj WHERE slope < 0 ORDER BY slope, actor LIMIT 10")
# All actors of the view meet in every window, so two of them are kept out of the first, or of the last, windows.
_without = lambda until: f", evw AS (SELECT * FROM evs WHERE NOT (actor1 IN ('u1', 'u2') OR actor2 IN ('u1', 'u2')) OR date {until})"
_TR_NEW, _TR_GONE = (_without(until) + _TR.replace("FROM evs", "FROM evw") for until in (">= DATE '2024-01-27'", "< DATE '2024-01-20'"))
_add("flux_emerging", lambda e: W.emerging(_path(W.windows(e.where("NOT (actor1 IN ('u1', 'u2') OR actor2 IN ('u1', 'u2')) OR date >= DATE '2024-01-27'"), 5)), 1), _TR_NEW + " SELECT * FROM tj WHERE first > last_window - 1 AND first > 0")
_add("flux_departed", lambda e: W.departed(_path(W.windows(e.where("NOT (actor1 IN ('u1', 'u2') OR actor2 IN ('u1', 'u2')) OR date < DATE '2024-01-20'"), 5)), 1), _TR_GONE + " SELECT * FROM tj WHERE last <= last_window - 1")
_add("flux_tie_changes", _placed(W.tie_changes), _W + ', o AS (SELECT w + 1 AS "to", a, b FROM ti), n AS (SELECT w AS "to", a, b FROM ti), fj AS (SELECT coalesce(o."to", n."to") AS "to", o.a AS oa, n.a AS na FROM o FULL JOIN n ON o."to" = n."to" AND o.a = n.a AND o.b = n.b) SELECT CAST("to" AS INT) AS "to", count(*) FILTER (WHERE oa IS NULL) AS formed, count(*) FILTER (WHERE na IS NULL) AS dissolved, count(*) FILTER (WHERE oa IS NOT NULL AND na IS NOT NULL) AS kept FROM fj, wm WHERE "to" BETWEEN 1 AND lw GROUP BY 1')
_add("flux_persistent_ties", _placed(W.persistent_ties), _W + " SELECT a, b, count(*) AS windows, CAST(sum(weight) AS BIGINT) AS weight FROM ti, wm GROUP BY a, b, lw HAVING count(*) = lw + 1")
_add("flux_emerging_ties", _placed(W.emerging_ties), _W + " SELECT a, b, CAST(sum(weight) AS BIGINT) AS weight FROM ti, wm GROUP BY a, b, lw HAVING min(w) = lw AND lw > 0")
_add("flux_trend", _placed(lambda p: _R(W.structural_trend(W.structure(p)), "first", "last", "change")), _W + _ST + ", rd AS (SELECT w, round(density, 6) AS d FROM sd), fl AS (SELECT count(*) AS windows, arg_min(d, w) AS first, arg_max(d, w) AS last FROM rd) SELECT windows, first + 0.0 AS first, last + 0.0 AS last, round(last - first, 6) + 0.0 AS change, CASE WHEN last - first > 0.05 THEN 'consolidating' WHEN last - first < -0.05 THEN 'fragmenting' ELSE 'stable' END AS trend FROM fl")
