"""Registered queries: events written by each sink and read again by the reader of that format."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.link import Tables
from ..sources import readers, sinks
from .bridge import EV_STREAM, ev_stream

Q, O = {}, {}

_counts = lambda: [F.count("*").alias("events"), F.sum("magnitude").cast("long").alias("magnitude"), F.countDistinct("date").alias("days")]
_BY = f"WITH {EV_STREAM} SELECT country, event_type, count(*) AS events, CAST(sum(magnitude) AS BIGINT) AS magnitude, count(DISTINCT date) AS days FROM evs GROUP BY 1, 2"


def _round_trip(name, write, read):
    def query(spark, sf_dir):
        path = f"{Tables(spark).path}/{name}"
        write(ev_stream(spark, sf_dir), path)
        return read(spark, path).groupBy("country", "event_type").agg(*_counts())

    Q[f"roundtrip_{name}"], O[f"roundtrip_{name}"] = query, _BY


_text = lambda make: lambda ev, path: make(ev).write.text(path)
_round_trip("jsonl", _text(sinks.to_jsonl), readers.jsonl)
_round_trip("geojson", _text(sinks.to_geojson_features), readers.geojson_seq)
_round_trip("kml", _text(sinks.to_kml_placemarks), readers.kml_lines)
_round_trip("csv", lambda ev, path: ev.write.option("header", True).option("escape", '"').csv(path), readers.acled)
_round_trip("tsv", lambda ev, path: ev.write.option("header", True).option("escape", '"').option("sep", "\t").csv(path), readers.delimited)
_round_trip("auto", _text(sinks.to_jsonl), readers.read_events)

Q["stix_objects"] = lambda s, d: sinks.to_stix_objects(ev_stream(s, d)).select(F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.id").alias("id")).groupBy("type").agg(F.count("*").alias("objects"), F.countDistinct("id").alias("ids"))
O["stix_objects"] = "SELECT type, count(*) AS objects, count(*) AS ids FROM events, (VALUES ('location'), ('observed-data'), ('note')) t(type) GROUP BY type"

_RAW = {"event_date": "CAST(date AS STRING)", "event_type": "event_type", "sub_event_type": "CASE WHEN seq % 2 = 0 THEN 'armed clash' ELSE '' END", "ACTOR1": "actor1", "country": "country", "location": "location", "fatalities": "CASE WHEN seq % 5 = 0 THEN '3.0' ELSE CAST(magnitude AS STRING) END", "latitude": "CASE WHEN seq % 7 = 0 THEN 'n/a' ELSE CAST(lat AS STRING) END", "longitude": "CAST(lon AS STRING)", "description": "notes", "extra": "'x'"}
Q["normalize"] = lambda s, d: readers.normalize(ev_stream(s, d).selectExpr("seq", *[f"{x} AS {n}" for n, x in _RAW.items()]), "raw").select("seq", "id", "date", "event_type", "actor1", "country", "location", "lat", "magnitude", "source")
O["normalize"] = f"""WITH {EV_STREAM}, k AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'battle' ELSE event_type END AS kind FROM evs) SELECT seq, sha1(concat_ws('|', CAST(date AS STRING), kind, country, location, actor1, notes[:60]))[:16] AS id, date, kind AS event_type, actor1, country, location, CASE WHEN seq % 7 <> 0 THEN lat END AS lat, CASE WHEN seq % 5 = 0 THEN 0 ELSE magnitude END AS magnitude, 'raw' AS source FROM k"""
