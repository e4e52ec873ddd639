"""Registered queries: files of other makers' formats, written from the benchmark tables and read by their readers; filters
by scope, day and severity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import detect as D
from ..operators import text as T
from ..operators.link import Tables
from ..sources import readers, sinks
from .bridge import EV_ORDERS, EV_STREAM, READINGS, ev_orders, ev_stream
from .bridge import readings as force_readings
from .core import _ACTOR_SQL, _ALERTS, _PLACE_SQL, _aged, _volume_sql

Q, O = {}, {}

_table = lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet")


def _add(name, write, read, sql):
    """write(spark, sf_dir, path), then read(spark, path)."""

    def query(spark, sf_dir):
        path = f"{Tables(spark).path}/{name}"
        write(spark, sf_dir, path)
        return read(spark, path)

    Q[name], O[name] = query, sql


_counts = lambda *by: lambda df: df.groupBy(*by).agg(F.count("*").alias("events"), F.sum("magnitude").cast("long").alias("magnitude"), F.countDistinct("date").alias("days"))
_UCDP = ["CAST(date AS STRING) AS date_start", "magnitude AS best", "actor1 AS side_a", "actor2 AS side_b", "country", "region AS adm_1", "location AS where_coordinates"]
_add("read_ucdp", lambda s, d, p: ev_orders(s, d).selectExpr(*_UCDP).write.option("header", True).csv(p), lambda s, p: _counts("country", "actor1", "source")(readers.ucdp(s, p)),
     f"WITH {EV_ORDERS} SELECT country, actor1, 'UCDP' AS source, count(*) AS events, CAST(sum(magnitude) AS BIGINT) AS magnitude, count(DISTINCT date) AS days FROM evo GROUP BY 1, 2")

_cells = lambda: F.concat_ws("\t", *[{1: F.date_format("date", "yyyyMMdd"), 6: F.col("actor1"), 16: F.col("actor2"), 52: F.concat_ws(", ", "location", "region", "country"), 56: F.col("lat").cast("string"), 57: F.col("lon").cast("string"), 60: F.concat(F.lit("http://g/"), F.col("seq"))}.get(i, F.lit("")) for i in range(61)])
_add("read_gdelt", lambda s, d, p: ev_stream(s, d).select(F.when(F.col("seq") % 10 == 0, "short\trow").otherwise(_cells())).write.text(p),
     lambda s, p: readers.gdelt(s, p).groupBy("country", "location", "event_type", "source").agg(F.count("*").alias("events"), F.countDistinct("date").alias("days"), F.round(F.sum("lat"), 6).alias("lat"), F.countDistinct("source_url").alias("links")),
     f"WITH {EV_STREAM} SELECT country, location, 'other' AS event_type, 'GDELT' AS source, count(*) AS events, count(DISTINCT date) AS days, round(sum(lat), 6) AS lat, count(*) AS links FROM evs WHERE seq % 10 <> 0 GROUP BY 1, 2")

_item = lambda: F.concat(F.lit("<item><title>"), "event_type", F.lit(" near "), "location", F.lit("</title><link>http://f/"), F.col("seq").cast("string"), F.lit("</link><pubDate>"), F.date_format("date", "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT</pubDate><description>report</description></item>"))
_entry = lambda: F.concat(F.lit("<entry><title>"), "event_type", F.lit("</title><link href=\"http://a/"), F.col("seq").cast("string"), F.lit("\"/><updated>"), F.col("date").cast("string"), F.lit("</updated><summary>report</summary></entry>"))
# A feed file for each day.
_feed = lambda ev, item, head, tail: ev.groupBy("date").agg(F.concat(F.lit(head), F.array_join(F.collect_list(item), ""), F.lit(tail)).alias("value")).write.partitionBy("date")
_rss = lambda ev, p: _feed(ev, _item(), "<rss><channel>", "</channel></rss>").text(p)
_atom = lambda ev, p: _feed(ev, _entry(), '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>").text(p)
_add("read_rss", lambda s, d, p: _rss(ev_stream(s, d), p), lambda s, p: readers.rss(s, f"{p}/date=*").groupBy("event_type", "date").agg(F.count("*").alias("events"), F.countDistinct("source_url").alias("links"), F.countDistinct("notes").alias("titles")),
     f"WITH {EV_STREAM} SELECT event_type, date, count(*) AS events, count(*) AS links, count(DISTINCT location) AS titles FROM evs GROUP BY 1, 2")
_add("read_feeds", lambda s, d, p: (_rss(ev_stream(s, d).where("seq % 2 = 0"), f"{p}/rss"), _atom(ev_stream(s, d).where("seq % 2 = 1"), f"{p}/atom")),
     lambda s, p: readers.feed_items(s, f"{p}/*/date=*").groupBy(F.regexp_extract("link", r"^http://(\w)", 1).alias("feed"), "summary").agg(F.count("*").alias("items"), F.countDistinct("published").alias("days")),
     f"WITH {EV_STREAM} SELECT CASE WHEN seq % 2 = 0 THEN 'f' ELSE 'a' END AS feed, 'report' AS summary, count(*) AS items, count(DISTINCT date) AS days FROM evs GROUP BY 1")
_line = lambda: F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('","'), F.upper("p_name"), F.lit('","-0-","'), "p_brand", F.lit('",-0-,-0-,-0-,-0-,-0-,-0-,-0-,"a.k.a. \''), "p_type", F.lit("'; a.k.a. 'X'.\""))
_add("read_watchlist", lambda s, d, p: _table(s, d, "part").select(_line()).write.text(p), lambda s, p: readers.sdn(s, p).select("ent_num", "sdn_name", "sdn_type", "program", F.array_join("aliases", "|").alias("aliases"), "all_names"),
     "SELECT CAST(p_partkey AS STRING) AS ent_num, upper(p_name) AS sdn_name, '' AS sdn_type, p_brand AS program, concat(p_type, '|X') AS aliases, concat_ws(' ', upper(p_name), p_type, 'X') AS all_names FROM part")
# A knowledge base is one document: the benchmark table is small by its nature.
_add("read_knowledge", lambda s, d, p: _table(s, d, "benchmark").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("item_id").alias("id"), "text")).alias("lessons")))).write.text(p), lambda s, p: readers.knowledge(s, p, "lessons").select("id", F.md5("text").alias("text")),
     "SELECT item_id AS id, md5(text) AS text FROM benchmark")
_READ = {"Day": "CAST(date AS STRING)", "system": "category", "party": "side", "made": "CAST(produced AS STRING)", "losses": "CAST(lost AS STRING)", "stock": "CAST(inventory AS STRING)"}
Q["read_readings"] = lambda s, d: readers.readings(force_readings(s, d).selectExpr("seq", *[f"{x} AS {n}" for n, x in _READ.items()])).groupBy("category", "side").agg(F.count("*").alias("readings"), F.sum("produced").alias("produced"), F.sum("lost").alias("lost"), F.count("inventory").alias("stocks"))
O["read_readings"] = f"WITH {READINGS} SELECT category, side, count(*) AS readings, sum(produced) AS produced, sum(lost) AS lost, count(inventory) AS stocks FROM rd GROUP BY 1, 2"
# A file for each country, each one object with a list.
_lists = lambda s, d: ev_stream(s, d).groupBy("country").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("date").alias("event_date"), F.col("event_type").alias("type"), F.col("actor1").alias("side_a"), F.col("country").alias("country"), F.col("magnitude").alias("killed"))).alias("events"))).alias("value"))
_add("read_json", lambda s, d, p: _lists(s, d).write.partitionBy("country").text(p), lambda s, p: _counts("country", "event_type")(readers.generic_json(s, f"{p}/country=*")),
     f"WITH {EV_STREAM} SELECT country, event_type, count(*) AS events, CAST(sum(magnitude) AS BIGINT) AS magnitude, count(DISTINCT date) AS days FROM evs GROUP BY 1, 2")
_BY = f"WITH {EV_STREAM} SELECT country, event_type, count(*) AS events, CAST(sum(magnitude) AS BIGINT) AS magnitude, count(DISTINCT date) AS days FROM evs GROUP BY 1, 2"
_back = lambda s, p: _counts("country", "event_type")(readers.read_events(s, p))
_add("roundtrip_auto_csv", lambda s, d, p: ev_stream(s, d).write.option("header", True).option("sep", ";").csv(p), _back, _BY)
_add("roundtrip_auto_kml", lambda s, d, p: s.createDataFrame([(sinks.to_kml(ev_stream(s, d).where("seq < 1000")),)], "value string").coalesce(1).write.text(p, lineSep="\n"), _back, _BY.replace("FROM evs", "FROM evs WHERE seq < 1000"))
_add("roundtrip_auto_geojson", lambda s, d, p: s.createDataFrame([(sinks.to_geojson(ev_stream(s, d).where("seq < 1000")),)], "value string").coalesce(1).write.text(p, lineSep="\n"), _back, _BY.replace("FROM evs", "FROM evs WHERE seq < 1000"))

# Filters --------------------------------------------------------------------------------------------------------------
_sums = "count(*) AS events, CAST(sum(magnitude) AS BIGINT) AS magnitude"
Q["in_scope"] = lambda s, d: A.timeline(A.within(ev_orders(s, d), country="NATION_7", as_of=date(2000, 1, 1)))
O["in_scope"] = f"WITH {EV_ORDERS} SELECT date, {_sums} FROM evo WHERE country = 'NATION_7' AND date <= DATE '2000-01-01' GROUP BY date"
Q["as_of_summary"] = lambda s, d: A.summary(A.within(ev_stream(s, d), as_of=date(2024, 1, 20)), 7).select("events", "magnitude", "first", "last", "recent", "prior")
O["as_of_summary"] = f"WITH {EV_STREAM}, e AS (SELECT * FROM evs WHERE date <= DATE '2024-01-20') SELECT {_sums}, min(date) AS first, max(date) AS last, count(*) FILTER (WHERE DATE '2024-01-20' - date < 7) AS recent, count(*) FILTER (WHERE DATE '2024-01-20' - date BETWEEN 7 AND 13) AS prior FROM e"
_severe = lambda low: lambda s, d: D.detect(ev_stream(s, d), "location", 3, 4, date(2024, 1, 20), low).select("scope", "detector", "severity", F.round("score", 6).alias("score"), "volume", "evidence")
Q["alerts_as_of"], Q["alerts_severe"] = _severe("info"), _severe("high")
_UNTIL = f"WITH {EV_STREAM}, evq AS (SELECT * FROM evs WHERE date <= DATE '2024-01-20') " + _aged("evq", "location", 3, 4) + _volume_sql(4) + _ACTOR_SQL + _PLACE_SQL + ", al AS (SELECT * FROM va UNION ALL SELECT * FROM aa UNION ALL SELECT * FROM pa)"
O["alerts_as_of"], O["alerts_severe"] = f"{_UNTIL} {_ALERTS} al", f"{_UNTIL} SELECT * FROM ({_ALERTS} al) WHERE severity IN ('high', 'critical')"
Q["report_registry"] = lambda s, d: T.entity_registry(T.to_events(ev_orders(s, d).select("seq", F.concat(F.lit("The Forces of "), F.initcap("region"), F.lit(" met the Red Brigade near Town on "), F.col("date").cast("string")).alias("text"))), 3)
O["report_registry"] = f"WITH {EV_ORDERS}, r AS (SELECT date, 'Forces of ' || array_to_string(list_transform(string_split(region, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS entity FROM evo UNION ALL SELECT date, 'Forces' FROM evo) SELECT entity, count(*) AS mentions, min(date) AS first_seen, max(date) AS last_seen, 1::BIGINT AS countries, 1::BIGINT AS types, 1::BIGINT AS surfaces FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"
