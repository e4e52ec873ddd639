"""Structured Streaming: windows over event time, watermarked de-duplication, and an incremental incident store.

Windows and watermarks are extensions of ours; the incident store follows the batch merge's predicate on events of one
country and neighbouring days, in arrival order."""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exprs import EARTH_KM, canonical
from ..functions.fixed import ACTOR_ALIASES


def dedupe_stream(ev: DataFrame, key: str = "id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return ev.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(ev: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = (), time: str = "ts", late: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums of tumbling, or sliding, windows."""
    ev = ev.withWatermark(time, late) if late else ev
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return ev.groupBy(w, *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "events", "total")


def sessions(ev: DataFrame, gap: str, keys: tuple[str, ...], time: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of events of a key without a gap of that length."""
    ev = ev.withWatermark(time, late) if late else ev
    got = ev.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("events"))
    return got.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


INCIDENT = "country string, seq long, cluster long, is_new boolean, size long, day int, event_type string, place string, lat double, lon double, magnitude long, sources string"
_STATE = "next long, open string"


#: Events are made into reports, and rows are given back, in slices of so many.
_SLICE = 50_000


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def _at(report: dict) -> tuple[float, float] | None:
    return None if report["lat"] is None or report["lon"] is None else (report["lat"], report["lon"])


class _Open:
    """The open incidents of a country, filed by day, by spot (place and coordinates), and there by type and by set of words.

    Incidents filed alike match the same events, so a heap of their numbers stands for them. An event looks at the spots near
    it and at the sets that share a word with its own; what it costs goes by the distinct spots and sets there, not by the
    incidents. Incidents of type other without words, which nothing can join, aren't filed."""

    def __init__(self, country: str, radius_km: float, threshold: float, incidents: list[dict]) -> None:
        self.country, self.radius_km, self.threshold = country, radius_km, threshold
        # Points within the radius are no further apart, straight through the globe, than a cell is wide.
        self.width = 2 * math.sin(min(radius_km / EARTH_KM, math.pi) / 2) * 1.001 + 1e-7
        self.known: dict[int, dict] = {}
        self.filed: dict[int, tuple] = {}
        self.days: dict[int, tuple[dict, dict]] = {}
        self.alike: dict[tuple[str, str], bool] = {}
        self.loner: dict | None = None
        for x in incidents:
            self.put(x)

    def put(self, x: dict) -> None:
        """Takes an incident in, or files it anew after it took a report in."""
        words = frozenset(x["words"])
        if x["kind"] == "other" and not words and self.threshold > 0:
            # Of those that nothing can join the latest is kept: its day counts for what is still open.
            if self.loner is None or x["day"] > self.loner["day"]:
                self.loner = x
            return
        self.known[x["id"]] = x
        at = _at(x)
        spot = (x["place"].lower(), at)
        where = (x["day"], spot, x["kind"], words)
        if self.filed.get(x["id"]) == where:
            return
        self.filed[x["id"]] = where
        places, cells = self.days.setdefault(x["day"], ({}, {}))
        kinds, sets, holding = places.setdefault(spot[0], {}).setdefault(at, ({}, {}, {}))
        if at is not None:
            cells.setdefault(self._cell(at), {})[spot] = (kinds, sets, holding)
        if x["kind"] != "other":
            heapq.heappush(kinds.setdefault(x["kind"], []), x["id"])
        if words not in sets:
            for w in words:
                holding.setdefault(w, {})[words] = True
        heapq.heappush(sets.setdefault(words, []), x["id"])

    def _cell(self, at: tuple[float, float]) -> tuple[int, int, int]:
        lat, lon = math.radians(at[0]), math.radians(at[1])
        return tuple(math.floor(v / self.width) for v in (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)))

    def _near(self, day: int, place: str, at: tuple[float, float] | None, cells: list[tuple]) -> Iterator[tuple]:
        """Spots of a day near an event: by distance where both are located; else one place's name holds the other, or one is
        blank in a named country."""
        places, located = self.days.get(day, ({}, {}))
        for other, spots in places.items():
            if at is not None and None not in spots:
                continue
            pair = (place, other)
            alike = self.alike.get(pair)
            if alike is None:
                alike = self.alike[pair] = (place in other or other in place) if place and other else bool(self.country)
            if alike:
                for there in (spots if at is None else (None,)):
                    yield (other, there), spots[there]
        for cell in cells:
            for spot, found in located.get(cell, {}).items():
                if _km(spot[1], at) <= self.radius_km:
                    yield spot, found

    def _first(self, numbers: list[int], day: int, spot: tuple, field: int, value: object) -> int | None:
        """The lowest number of a heap that is still filed there."""
        while numbers:
            where = self.filed[numbers[0]]
            if where[0] == day and where[1] == spot and where[field] == value:
                return numbers[0]
            heapq.heappop(numbers)
        return None

    def match(self, event: dict, words: frozenset, day_gap: int) -> int | None:
        """The lowest-numbered incident of neighbouring days that is near the event, and of its type or alike in words."""
        best, at, place = None, _at(event), event["place"].lower()
        cells = [tuple(map(sum, zip(self._cell(at), step, strict=True))) for step in product((-1, 0, 1), repeat=3)] if at is not None else []
        for day in range(event["day"] - day_gap, event["day"] + day_gap + 1):
            for spot, (kinds, sets, holding) in self._near(day, place, at, cells):
                if event["kind"] in kinds:
                    i = self._first(kinds[event["kind"]], day, spot, 2, event["kind"])
                    if i is None:
                        del kinds[event["kind"]]
                    elif best is None or i < best:
                        best = i
                sharing = sets if self.threshold <= 0 else {s: True for w in words for s in holding.get(w, ())}
                for other in list(sharing):
                    i = self._first(sets[other], day, spot, 3, other)
                    if i is None:
                        del sets[other]
                        for w in other:
                            del holding[w][other]
                    elif best is None or i < best:
                        either = len(words | other)
                        if either and len(words & other) / either >= self.threshold:
                            best = i
        return best

    def kept(self, days: int) -> list[dict]:
        """The incidents of the last days, by number."""
        every = sorted([*self.known.values(), *([self.loner] if self.loner else [])], key=lambda x: x["id"])
        newest = max((x["day"] for x in every), default=0)
        return [x for x in every if x["day"] >= newest - days]


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """seq, day, event_type, place, words, lat, lon, magnitude, source of a country's rows by seq. The rows are held as numbers,
    texts and sets of words as places in a list of the distinct ones."""
    number, code = ("seq", "day", "lat", "lon", "magnitude"), ("event_type", "place", "words", "source")
    seen: dict[str, dict] = {c: {} for c in code}
    parts: dict[str, list[np.ndarray]] = {c: [] for c in (*number, *code)}
    for f in frames:
        for c in number:
            parts[c].append(f[c].to_numpy() if c == "seq" else pd.to_numeric(f[c]).to_numpy("float64", na_value=np.nan))
        for c in code:
            values = (() if v is None else tuple(sorted(set(v))) for v in f[c]) if c == "words" else (None if pd.isna(v) else v for v in f[c])
            parts[c].append(np.fromiter((seen[c].setdefault(v, len(seen[c])) for v in values), "int32", len(f)))
    whole = {c: np.concatenate(p) for c, p in parts.items()}
    order = np.argsort(whole["seq"], kind="stable")
    distinct = {c: list(seen[c]) for c in code}
    for start in range(0, len(order), _SLICE):
        part = order[start : start + _SLICE]
        col = {c: whole[c][part].tolist() for c in whole}
        col |= {c: [None if math.isnan(v) else v for v in col[c]] for c in number[1:]}
        col |= {c: [distinct[c][v] for v in col[c]] for c in code}
        yield from zip(*(col[c] for c in ("seq", "day", "event_type", "place", "words", "lat", "lon", "magnitude", "source")), strict=True)


def _folded(incident: dict, event: dict) -> dict:
    """The canonical record with one report more: earliest day, largest magnitude, longest place and words, the first
    coordinates, the commonest type (other only if there is none else, ties to the one that came first), all sources."""
    kinds = incident["kinds"]
    kinds[event["kind"]] = kinds.get(event["kind"], 0) + 1
    named = {k: n for k, n in kinds.items() if k != "other"}
    top = max(kinds, key=kinds.get)
    return {
        "id": incident["id"], "size": incident["size"] + 1, "kinds": kinds, "kind": max(named, key=named.get) if top == "other" and named else top, "day": min(incident["day"], event["day"]),
        "place": max(incident["place"], event["place"], key=len), "words": max(incident["words"], event["words"], key=len), "magnitude": max(incident["magnitude"], event["magnitude"]),
        "lat": incident["lat"] if incident["lat"] is not None else event["lat"], "lon": incident["lon"] if incident["lon"] is not None else event["lon"], "sources": sorted({*incident["sources"], *event["sources"]}),
    }


def incident_store(ev: DataFrame, day_gap: int = 1, threshold: float = 0.5, keep_days: int = 60, radius_km: float = 15.0) -> DataFrame:
    """For each event its incident: the lowest-numbered open one of its country that it matches, or a new one; with the
    incident's canonical record as it is then.

    Events meet the incidents of neighbouring days only, by an index (``_Open``). State is one row a country, of incidents
    seen in the last ``keep_days``, so it doesn't grow with the stream; a country's events of one micro-batch are held at once,
    in some 60 bytes each, so bound batches at the source. ev has seq, country, day (int), event_type, place, words (array),
    lat, lon, magnitude, source. Events without a day are incidents of their own, which nothing joins."""

    names = [c.split()[0] for c in INCIDENT.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, text = state.get if state.exists else (0, "[]")
        store = _Open(key[0] or "", radius_km, threshold, json.loads(text))
        sets: dict[tuple, frozenset] = {}
        out = []
        for seq, day, kind, place, words, lat, lon, magnitude, source in _in_order(frames):
            event = {"kind": kind, "place": place or "", "words": list(words), "lat": lat, "lon": lon, "magnitude": int(magnitude or 0), "day": None if day is None else int(day), "sources": [source] if source else []}
            if words not in sets:
                sets[words] = frozenset(words)
            hit = store.match(event, sets[words], day_gap) if day is not None else None
            if hit is None:
                now = event | {"id": following, "size": 1, "kinds": {event["kind"]: 1}}
                following += 1
            else:
                now = _folded(store.known[hit], event)
            if day is not None:
                store.put(now)
            out.append((key[0], seq, now["id"], hit is None, now["size"], now["day"], now["kind"], now["place"], now["lat"], now["lon"], now["magnitude"], " | ".join(now["sources"])))
            if len(out) == _SLICE:
                yield pd.DataFrame(out, columns=names).astype({"day": "Int32"})
                out = []
        state.update((following, json.dumps(store.kept(keep_days))))
        yield pd.DataFrame(out, columns=names).astype({"day": "Int32"})

    return ev.groupBy("country").applyInPandasWithState(step, INCIDENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def entity_stream(ev: DataFrame) -> DataFrame:
    """The registry of actors of a stream, as it grows (update or complete mode): entity, mentions, first and last day, and
    counts of types and of places. Counts by type and place are kept, so state grows with actors, not with events."""
    slots = ev.select("date", "country", "event_type", F.explode(F.array("actor1", "actor2")).alias("surface")).where("trim(surface) <> ''")
    named = slots.withColumn("entity", canonical(F.col("surface"), ACTOR_ALIASES)).where("entity <> ''")
    return named.groupBy("entity").agg(F.count("*").alias("mentions"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.size(F.collect_set("event_type")).alias("types"), F.size(F.collect_set("country")).alias("countries"))
