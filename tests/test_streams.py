import datetime as dt
import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldglass.plans.streams import run
from fieldglass.streaming import streams as S

SCHEMA = "seq long, country string, day int, event_type string, place string, words array<string>, lat double, lon double, magnitude int, source string"


def km(a, b):
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def brute(rows, day_gap=1, threshold=0.5, radius=15.0):
    """The store, event by event: incidents hold their reports, and the canonical record is made anew each time."""
    state, out = {}, []

    def record(reports):
        kinds = Counter(r[3] for r in reports)
        best = max(kinds.values())
        kind = next(k for k in kinds if kinds[k] == best)
        if kind == "other" and len(kinds) > 1:
            del kinds["other"]
            kind = next(k for k in kinds if kinds[k] == max(kinds.values()))
        place = next(r[4] for r in reports if len(r[4]) == max(len(x[4]) for x in reports))
        words = next(set(r[5]) for r in reports if len(set(r[5])) == max(len(set(x[5])) for x in reports))
        at = next(((r[6], r[7]) for r in reports if r[6] is not None), (None, None))
        return min(r[2] for r in reports if r[2] is not None) if reports[0][2] is not None else None, kind, place, words, at, max(r[8] for r in reports), " | ".join(sorted({r[9] for r in reports}))

    for row in sorted(rows, key=lambda r: r[0]):
        seq, country, day, kind, place, words, lat, lon, magnitude, source = row
        incidents, hit = state.setdefault(country, []), None
        for i, reports in enumerate(incidents):
            d, k, p, w, at, _, _ = record(reports)
            if day is None or d is None or abs(d - day) > day_gap:
                continue
            a, b = place.lower(), p.lower()
            near = km(at, (lat, lon)) <= radius if None not in (*at, lat, lon) else (a in b or b in a) if a and b else country != ""
            both, either = len(set(words) & w), len(set(words) | w)
            if near and ((either and both / either >= threshold) or (kind == k and kind != "other")):
                hit = i
                break
        if hit is None:
            incidents.append([])
            hit, new = len(incidents) - 1, True
        else:
            new = False
        incidents[hit].append(row)
        d, k, p, _, at, m, sources = record(incidents[hit])
        out.append((country, seq, hit, new, len(incidents[hit]), d, k, p, *at, m, sources))
    return sorted(out, key=repr)


def source(spark, folder, batches, schema=SCHEMA):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{i:02d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_incident_store_matches_brute_force(spark, tmp_path, seed):
    r = random.Random(seed)
    spot = lambda: r.choice([(None, None), (10.0, 10.0), (10.05, 10.02), (12.0, 10.0)])
    rows = [(i, r.choice(["X", "Y", ""]), None if r.random() < 0.05 else r.randrange(8), r.choice(["battle", "other", "riots"]), r.choice(["", "Town", "town north", "hill"]), r.sample(["a1", "b2", "c3", "d4"], r.randrange(0, 4)), *spot(), r.randrange(5), r.choice("ST")) for i in range(120)]
    df = source(spark, str(tmp_path / "src"), [rows])
    got = sorted((tuple(x) for x in run(S.incident_store(df), "append").collect()), key=repr)
    assert got == brute(rows)


def test_incident_store_goes_on_from_its_state(spark, tmp_path):
    r = random.Random(3)
    spot = lambda: r.choice([(None, None), (10.0, 179.95), (10.05, -179.98), (89.99, 10.0), (89.99, -170.0), (10.0, None)])
    rows = [(i, r.choice(["X", "", None]), None if r.random() < 0.05 else r.randrange(8), r.choice(["battle", "other", "other"]), r.choice(["", "Town", "town north", "hill"]), r.sample(["a1", "b2", "c3", "d4"], r.randrange(0, 4)), *spot(), r.randrange(5), r.choice("ST")) for i in range(160)]
    rows = [x if x[1] else (x[0], "", *x[2:]) for x in rows]
    source(spark, str(tmp_path / "src"), [rows[:80]])
    time.sleep(1.1)  # files are taken by their age
    source(spark, str(tmp_path / "more"), [rows[80:]])
    (tmp_path / "more" / "in00").rename(tmp_path / "src" / "in01")
    df = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    # Coordinates may come from two reports: the canonical record holds the first of each.
    located = [x for x in rows if (x[6] is None) == (x[7] is None)]
    got = sorted((tuple(x) for x in run(S.incident_store(df.where("(lat IS NULL) = (lon IS NULL)")), "append").collect()), key=repr)
    assert got == brute(located)


def test_incidents_that_nothing_can_join_cost_nothing(spark, tmp_path):
    # Each report without words opens an incident; every later one was held against all of them (134 s).
    rows = [(i, "X", 1, "other", "Town", [], None, None, 0, "S") for i in range(12_000)]
    df = source(spark, str(tmp_path / "src"), [rows])
    began = time.monotonic()
    got = run(S.incident_store(df), "append")
    assert got.count() == 12_000 and got.where("NOT is_new").count() == 0 and got.agg(F.max("cluster")).first()[0] == 11_999
    assert time.monotonic() - began < 25


def test_duplicates_leave_the_stream_once(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(f"id{i % 7}", at + dt.timedelta(minutes=i)) for i in range(40)]
    df = source(spark, str(tmp_path / "src"), [rows[:20], rows[20:]], "id string, ts timestamp")
    assert sorted(r.id for r in run(S.dedupe_stream(df), "append").collect()) == [f"id{i}" for i in range(7)]


def test_windows_and_sessions(spark):
    at = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("k", at, 1), ("k", at + dt.timedelta(minutes=9), 2), ("k", at + dt.timedelta(minutes=30), 4)], "key string, ts timestamp, value long")
    assert sorted((r.events, r.total) for r in S.windowed(df, "10 minutes").collect()) == [(1, 4), (2, 3)]
    assert S.windowed(df, "10 minutes", "5 minutes").agg(F.sum("events")).first()[0] == 6
    assert sorted(r.events for r in S.sessions(df, "10 minutes", ("key",)).collect()) == [1, 2]
