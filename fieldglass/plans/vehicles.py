"""Registered queries: bearers, relay routes, fused navigation, terrain fixes and sonar contacts, over rows derived from the
benchmark tables by expressions that mean the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vehicles as V

Q, O = {}, {}

_table = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")
_cols = lambda exprs: [f"{x} AS {n}" for n, x in exprs.items()]
_sql = lambda exprs, table: "SELECT " + ", ".join(_cols(exprs)) + f" FROM {table}"

_BEARERS = {"vehicle": "p_partkey % 50", "name": "concat('b', CAST(p_partkey AS STRING))", "bandwidth": "CAST((p_partkey * 37) % 900 AS DOUBLE)", "latency": "CAST((p_partkey * 11) % 70 AS DOUBLE)", "available": "p_partkey % 9 <> 0", "signature": "CAST(p_size AS DOUBLE) / 40", "reach_km": "CAST(p_size AS DOUBLE)"}
_NEEDS = {"need": "o_orderkey", "vehicle": "o_custkey % 55", "min_bandwidth": "CAST(o_orderkey % 500 AS DOUBLE)", "max_latency": "CAST(20 + o_orderkey % 60 AS DOUBLE)", "range_km": "CAST(o_orderkey % 30 AS DOUBLE)", "prefer": "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'low_signature' WHEN 1 THEN 'bandwidth' ELSE 'latency' END"}
Q["bearer_choice"] = lambda s, d: V.choose_bearers(_table(s, d, "orders").selectExpr(*_cols(_NEEDS)), _table(s, d, "part").selectExpr(*_cols(_BEARERS)))
O["bearer_choice"] = f"""WITH n AS ({_sql(_NEEDS, 'orders')}), b AS ({_sql(_BEARERS, 'part')}), m AS (SELECT need, name, row_number() OVER (PARTITION BY need ORDER BY CASE prefer WHEN 'bandwidth' THEN -bandwidth WHEN 'latency' THEN latency ELSE least(signature, 1.0) END,
CASE prefer WHEN 'low_signature' THEN latency ELSE least(signature, 1.0) END, CASE prefer WHEN 'bandwidth' THEN latency ELSE -bandwidth END, name) AS r FROM n JOIN b USING (vehicle) WHERE available AND bandwidth >= min_bandwidth AND latency <= max_latency AND reach_km >= range_km)
SELECT n.need, name AS bearer FROM n LEFT JOIN m ON m.need = n.need AND r = 1"""

_LINKS = {"a": "concat('v', CAST(user_id % 40 AS STRING))", "b": "concat('v', CAST((user_id * 3 + event_id % 4) % 40 AS STRING))", "quality": "CAST(event_id % 101 AS DOUBLE) / 100", "seq": "event_id"}
_few = lambda s, d: _table(s, d, "events").where("event_id % 7 = 0").selectExpr(*_cols(_LINKS))  # noqa: E731  (a sparse net, so that routes have several links)
Q["relay_routes"] = lambda s, d: V.widest_routes(_few(s, d), _few(s, d).where("a IN ('v0', 'v1', 'v2')").select(F.col("a").alias("src")), 0.2).select("src", "node", "bottleneck")
O["relay_routes"] = f"""WITH RECURSIVE l AS ({_sql(_LINKS, 'events WHERE event_id % 7 = 0')}), o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, arg_max(quality, seq) AS q FROM l GROUP BY 1, 2 HAVING arg_max(quality, seq) > 0.2::DOUBLE),
w AS (SELECT a AS u, b AS v, q FROM o WHERE a <> b UNION ALL SELECT b, a, q FROM o WHERE a <> b), r AS (SELECT DISTINCT a AS src, a AS node, 1.0::DOUBLE AS q FROM l WHERE a IN ('v0', 'v1', 'v2') UNION SELECT r.src, w.v, least(r.q, w.q) FROM r JOIN w ON w.u = r.node)
SELECT src, node, max(q) AS bottleneck FROM r GROUP BY 1, 2"""

_STEPS = {"drive": "user_id", "seq": "event_id", "speed": "CAST(event_id % 7 AS DOUBLE)", "heading_rate": "CAST(event_id % 11 - 5 AS DOUBLE) / 20", "dt": "CAST(1 + event_id % 3 AS DOUBLE)", "fix_x": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS DOUBLE) END", "fix_y": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 30 AS DOUBLE) END", "fix_variance": "CAST(1 + event_id % 9 AS DOUBLE)", "fix_source": "CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'gnss' WHEN 1 THEN 'vio' ELSE 'terrain' END"}
Q["navigation"] = lambda s, d: V.navigate(_table(s, d, "events").selectExpr(*_cols(_STEPS))).select("drive", "seq", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x", "y", "variance", "quality")], "mode")
O["navigation"] = f"""WITH RECURSIVE st AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY seq) AS k, fix_x IS NOT NULL AS fixed FROM ({_sql(_STEPS, 'events')})),
n AS (SELECT drive, 0::BIGINT AS k, 0::BIGINT AS seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS h, 25.0::DOUBLE AS v, 'dead-reckoning' AS mode FROM (SELECT DISTINCT drive FROM st) UNION ALL
SELECT drive, k, seq, CASE WHEN fixed THEN px + pv / (pv + fv) * (fx - px) ELSE px END, CASE WHEN fixed THEN py + pv / (pv + fv) * (fy - py) ELSE py END, h, CASE WHEN fixed THEN (1 - pv / (pv + fv)) * pv ELSE pv END,
CASE WHEN NOT fixed THEN mode WHEN src = 'gnss' THEN 'gnss' WHEN src = 'vio' THEN 'odometry-aided' ELSE 'terrain-relative' END
FROM (SELECT st.drive, st.k, st.seq, fixed, fix_x AS fx, fix_y AS fy, fix_variance AS fv, fix_source AS src, mode, n.x + speed * dt * cos(h + heading_rate * dt / 2) AS px, n.y + speed * dt * sin(h + heading_rate * dt / 2) AS py, h + heading_rate * dt AS h, least(1e6, v + 0.5::DOUBLE * dt) AS pv FROM n JOIN st ON st.drive = n.drive AND st.k = n.k + 1))
SELECT drive, seq, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(v, 6) + 0.0 AS variance, round(1 / (1 + v / 100), 6) + 0.0 AS quality, mode FROM n WHERE k > 0"""

_HILLS = [[float((i * 7 + j * 13) % 29 + i * j % 5) for i in range(24)] for j in range(24)]
_sample = lambda k: F.struct(F.lit(float(k * 6)).alias("dx"), F.lit(float(k * 4 - 8)).alias("dy"), (F.col("event_id") % (20 + k)).cast("double").alias("height"))
Q["terrain_fixes"] = lambda s, d: V.terrain_fixes(_table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("key"), (F.col("user_id") % 200).cast("double").alias("guess_x"), (F.col("event_id") % 200).cast("double").alias("guess_y"), F.array(*[_sample(k) for k in range(5)]).alias("samples")), _HILLS)

#: An image for each part: a bright block with a dark strip behind it on grey ground, and single bright pixels.
_ground = lambda i, j: F.lit(40.0) + (F.col("p_partkey") * 3 + i * 5 + j * 7) % 6
_row = lambda j: F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: F.when(i.between(10, 12 + F.col("p_size") % 8) & F.lit(j).between(5, 7) | (i == 40) & (F.lit(j) == 2), 200.0).when((i > 12 + F.col("p_size") % 8) & (i <= 13 + F.col("p_size") % 8 + F.col("p_partkey") % 12) & F.lit(j).between(5, 7), 1.0).otherwise(_ground(i, j)))
_parts = lambda s, d: _table(s, d, "part").select("p_partkey", "p_size").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # noqa: E731  (a small file is one task; its images are many bytes)
_images = lambda s, d: _parts(s, d).select(F.col("p_partkey").alias("image"), F.array(*[_row(j) for j in range(12)]).alias("pixels"), F.lit(0.1).alias("across_m"), F.lit(0.2).alias("along_m"), F.lit(10.0).alias("altitude"))
Q["sonar_contacts"] = lambda s, d: V.sonar_contacts(_images(s, d))
Q["sonar_summary"] = lambda s, d: V.contact_summary(V.sonar_contacts(_images(s, d)))
