"""Writers and renderers of events. Per-row formats are projections that executors write; reports aggregate in Spark and
format a result of bounded size on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregates

_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
COLOURS = {"critical": "ff0000ff", "high": "ff0055ff", "medium": "ff00aaff", "low": "ff00ffaa", "info": "ffaaaaaa"}


def to_jsonl(ev: DataFrame) -> DataFrame:
    """A JSON object a row, with the severity."""
    return ev.select(F.to_json(F.struct("*", X.severity().alias("severity"))).alias("value"))


def to_json(ev: DataFrame, most: int = 1_000_000) -> str:
    """One JSON list of all events with their severity. It is a single text, so it refuses over ``most`` events: write
    ``to_jsonl`` for more."""
    return wrap(to_jsonl(ev), "[", "]", ",\n", most)


def to_geojson_features(ev: DataFrame) -> DataFrame:
    """A feature a row, for located events."""
    props = F.struct(*[c for c in ev.columns if c not in ("lat", "lon")], X.severity().alias("severity"))
    shape = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return ev.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("value"))


def uuid5(name: Column) -> Column:
    """A name-based identifier (SHA-1, version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def to_stix_objects(ev: DataFrame) -> DataFrame:
    """Three objects an event: a location, observed data and a note; ids come from the event's id, so they are stable."""
    key = F.col("id") if "id" in ev.columns else F.col("seq").cast("string")
    stamp = F.date_format(F.coalesce("date", F.lit("1970-01-01").cast("date")), "yyyy-MM-dd'T'00:00:00'Z'")
    oid = lambda kind: F.concat(F.lit(f"{kind}--"), uuid5(F.concat_ws(":", F.lit(kind), key)))
    common = lambda kind: [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), oid(kind).alias("id"), stamp.alias("created"), stamp.alias("modified")]
    where = F.to_json(F.struct(*common("location"), X.first_of("location", "region", "country", default="unknown").alias("name"), F.col("country"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")))
    seen = F.to_json(F.struct(*common("observed-data"), stamp.alias("first_observed"), stamp.alias("last_observed"), F.lit(1).alias("number_observed"), F.array(oid("location")).alias("object_refs")))
    note = F.to_json(F.struct(*common("note"), F.col("notes").alias("content"), X.severity().alias("abstract"), F.array(oid("observed-data")).alias("object_refs")))
    return ev.select(F.explode(F.array(where, seen, note)).alias("value"))


def _xml(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def to_kml_placemarks(ev: DataFrame) -> DataFrame:
    """A Placemark a row for located events; fields that aren't blank or 0 ride in ExtendedData."""
    # One expression over a list instead of one a field: the code made of so many is too long for the JVM to compile.
    fields = F.array(*[F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in ("event_type", "actor1", "actor2", "country", "region", "magnitude", "source")])
    data = F.array_join(F.transform(F.filter(fields, lambda d: ~d["v"].isin("", "0")), lambda d: F.concat(F.lit('<Data name="'), d["k"], F.lit('"><value>'), _xml(d["v"]), F.lit("</value></Data>"))), "")
    parts = [F.lit("<Placemark><name>"), _xml(X.first_of("location", "region", "country", default="event")), F.lit("</name><description>"), _xml(F.col("notes")), F.lit("</description><TimeStamp><when>"), F.coalesce(F.col("date").cast("string"), F.lit("")), F.lit("</when></TimeStamp><ExtendedData>"), data, F.lit("</ExtendedData><Point><coordinates>"), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("</coordinates></Point></Placemark>")]
    return ev.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.concat(*parts).alias("value"))


def wrap(rows: DataFrame, head: str, foot: str, between: str, limit: int = 100_000) -> str:
    """One document of a bounded number of rows; larger exports stay a file of rows for each task."""
    got = [r.value for r in rows.limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"over {limit} rows; write the rows with .write.text instead")
    return head + between.join(got) + foot


def to_geojson(ev: DataFrame) -> str:
    return wrap(to_geojson_features(ev), '{"type":"FeatureCollection","features":[', "]}", ",")


def to_stix(ev: DataFrame) -> str:
    return wrap(to_stix_objects(ev), '{"type":"bundle","objects":[', "]}", ",")


def to_kml(ev: DataFrame, name: str = "events") -> str:
    styles = "".join(f'<Style id="{s}"><IconStyle><color>{c}</color></IconStyle></Style>' for s, c in COLOURS.items())
    return wrap(to_kml_placemarks(ev), f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(name)}</name>{styles}', "</Document></kml>", "")


def csv_rows(ev: DataFrame) -> DataFrame:
    """Timeline rows as text, for .write.csv."""
    return aggregates.timeline(ev).select(F.col("date").cast("string").alias("date"), "events", "magnitude").orderBy("date")


def trend_word(escalating: bool, pct: float) -> str:
    return ("ESCALATING" if pct >= 25 else "elevated") if escalating else "declining" if pct < 0 else "steady"


def report(ev: DataFrame, window: int = 7, top: int = 5) -> dict:
    """The figures of a situation report: totals, trend, hotspots, types."""
    s = aggregates.summary(ev, window).first().asDict()
    return {**{k: (str(v) if hasattr(v, "isoformat") else v) for k, v in s.items()}, "word": trend_word(bool(s["escalating"]), s["pct_change"] or 0.0), "hotspots": [r.asDict() for r in aggregates.hotspots(ev, top).collect()], "types": {r.event_type: r.events for r in aggregates.by_type(ev).collect()}}


def to_markdown(ev: DataFrame, window: int = 7) -> str:
    r = report(ev, window)
    rows = [f"| {h['country']} | {h['place']} | {h['events']} | {h['magnitude']} |" for h in r["hotspots"]]
    kinds = [f"- {k}: {n}" for k, n in sorted(r["types"].items(), key=lambda x: (-x[1], x[0]))]
    return "\n".join([f"# Events {r['first']} to {r['last']}", "", f"{r['events']} events, magnitude {r['magnitude']}, trend {r['word']} ({r['pct_change']:+.1f} %).", "", "| country | place | events | magnitude |", "| --- | --- | --- | --- |", *rows, "", *kinds, ""])


def to_intsum(ev: DataFrame, window: int = 7) -> str:
    r = report(ev, window)
    return "\n".join([f"PERIOD: {r['first']} - {r['last']}", f"EVENTS: {r['events']}  MAGNITUDE: {r['magnitude']}", f"TREND: {r['word']} ({r['recent']} against {r['prior']})", "HOTSPOTS: " + "; ".join(f"{h['country']}/{h['place']} ({h['events']})" for h in r["hotspots"])])


EXPORTS: dict[str, Callable[[DataFrame], str | DataFrame]] = {"jsonl": to_jsonl, "geojson": to_geojson, "stix": to_stix, "kml": to_kml, "csv": csv_rows, "markdown": to_markdown, "intsum": to_intsum, "json": to_json, "report": lambda ev: json.dumps(report(ev), default=str)}


def export(ev: DataFrame, fmt: str) -> str | DataFrame:
    if fmt not in EXPORTS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(sorted(EXPORTS))}")
    return EXPORTS[fmt](ev)
