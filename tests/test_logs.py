import datetime as dt

import pytest

from fieldglass.operators import attrition as T
from fieldglass.operators import harvest as H
from fieldglass.operators import logs as L


def sources(spark):
    return spark.createDataFrame([(0, "a", "http://a.org/x", "tool"), (1, "b", "http://b.org/x?y=1", "tracker"), (2, "a", "http://late.org", "tool"), (3, "c", "ftp://c.org", "tool"), (4, "d", "http://d.org", "news")], "seq long, name string, url string, type string")


def test_expansion(spark):
    got = H.expand(H.parametric_sources(sources(spark)), ["x", "y", "x"]).orderBy("seq").collect()
    assert [(r.key, r.url) for r in got] == [("a:_all", "http://a.org/x"), ("a:q=x", "http://a.org/x?q=x"), ("a:q=y", "http://a.org/x?q=y"), ("b:_all", "http://b.org/x?y=1"), ("b:q=x", "http://b.org/x?y=1&q=x"), ("b:q=y", "http://b.org/x?y=1&q=y")]
    assert H.expand(H.parametric_sources(sources(spark)), ["x"], base=False).count() == 2


def test_harvest_grows_and_keeps_records_once(spark):
    engine = H.Harvest(spark)
    ends = H.expand(H.parametric_sources(sources(spark)), ["x"])
    assert engine.add_endpoints(ends) == 4 and engine.add_endpoints(ends) == 0
    first = engine.run_cycle(1.0)
    assert (first.fetched_endpoints, first.records_seen, first.new_records, first.growth_rate) == (4, 12, 12, 1.0)
    same, later = engine.run_cycle(1.5), engine.run_cycle(2.0)  # the same whole second brings nothing new
    assert (same.new_records, same.total_size, later.new_records, later.total_size) == (0, 12, 12, 24)
    stats = {r.source: r for r in H.source_stats(engine.log).collect()}
    assert (stats["a"].fetches, stats["a"].records, stats["a"].new_records) == (6, 18, 12)
    assert stats["a"].reliability == pytest.approx(0.3 * (0.5 + 0.5 * 12 / 19), abs=1e-6)
    assert engine.run_cycle(3.0, top=1).fetched_endpoints == 1
    assert {r.source: r.mean_age_s for r in H.freshness(engine.store, 3.0).where("source = 'b'").collect()} == {"b": pytest.approx(1.5)}
    with pytest.raises(ValueError, match="at least 1"):
        engine.grow(0)


def test_discovered_endpoints_join_the_frontier(spark):
    engine = H.Harvest(spark, discover=lambda records: records.selectExpr("100L AS seq", "source", "concat(endpoint, '/more') AS key", "'http://more' AS url").distinct())
    engine.add_endpoints(H.expand(H.parametric_sources(sources(spark)), []))
    assert [c.frontier for c in engine.grow(2)] == [4, 6]


def test_unknown_sources_come_first(spark):
    log = spark.createDataFrame([("a", 1.0, 5, 5, 0), ("a", 2.0, 5, 0, 1)], H.FETCH)
    got = [r.source for r in H.prioritized(H.expand(H.parametric_sources(sources(spark)), []), H.source_stats(log)).collect()]
    assert got == ["b", "a"]
    assert H.source_stats(log.limit(0)).count() == 0


def test_replay_and_after_action(spark):
    log = spark.createDataFrame([(2.0, "nav", 3), (1.0, "nav", 2), (1.0, "event", 1)], "t double, channel string, seq long")
    assert [r.seq for r in L.replay(log).collect()] == [1, 2, 3] and [r.seq for r in L.replay(log, "nav", 1.5).collect()] == [3]
    whole = {r.channel: tuple(r)[1:] for r in L.after_action(log).collect()}
    assert whole == {None: (3, 1.0, 2.0, 1.0), "nav": (2, 1.0, 2.0, 1.0), "event": (1, 1.0, 1.0, 0.0)}


@pytest.mark.parametrize("lateral,want", [(1.2, "ok"), (1.21, "minor"), (1.5, "minor"), (1.51, "moderate"), (1.92, "moderate"), (1.93, "severe")])
def test_ride_bands(spark, lateral, want):
    rows = spark.createDataFrame([("v", 0.0, 0.0, lateral, 0.0, 0.0)], "vehicle string, t double, accel double, lateral double, tilt double, speed double")
    assert L.ride_verdicts(rows).first().severity == want


def test_ride_jerk(spark):
    rows = spark.createDataFrame([("v", 0.0, 0.0, 0.0, 0.0, 0.0), ("v", 0.5, 1.0, 0.0, 0.0, 0.0), ("w", 0.6, 1.0, 0.0, 0.0, 0.0)], "vehicle string, t double, accel double, lateral double, tilt double, speed double")
    got = {(r.vehicle, r.t): r for r in L.ride_verdicts(rows).collect()}
    assert got["v", 0.5].jerk == 2.0 and got["v", 0.5].worst_axis == "jerk" and got["v", 0.5].severity == "severe" and got["w", 0.6].jerk == 0.0 and got["v", 0.0].worst_axis is None
    report = {r.vehicle: r for r in L.ride_report(L.ride_verdicts(rows)).collect()}
    assert report["v"].ride_quality == 0.75 and not report["v"].acceptable and report["w"].acceptable


@pytest.mark.parametrize("days,burn,status,triggers", [(0.0, 1.0, "black", True), (1.0, 1.0, "critical", True), (2.0, 1.0, "reorder", True), (2.1, 1.0, "green", True), (9.1, 1.0, "green", False), (9.1, 2.0, "green", True), (0.0, 0.0, "green", False)])
def test_stock_status(spark, days, burn, status, triggers):
    df = spark.createDataFrame([("i", days, burn, 2.0, 1.0)], "item string, days_on_hand double, burn double, trigger_days double, critical_days double")
    r = L.stock_status(df).first()
    assert (r.status, r.triggers) == (status, triggers)


def test_requirement_and_packing(spark):
    need = {r["item"]: r for r in L.requirement(spark.createDataFrame([("u", 39, 1.5)], "unit string, strength int, days double")).collect()}
    assert need["I"].person_days == 59 and need["I"].weight == 118.0 and len(need) == 6
    items = spark.createDataFrame([("v", "a", 50.0, 1.0), ("v", "b", 40.0, 1.0), ("v", "c", 30.0, 1.0), ("v", "d", 200.0, 1.0)], "vehicle string, item string, weight double, volume double")
    assert {r["item"]: r.bay for r in L.pack(items, [(80.0, 9.0), (60.0, 9.0)]).collect()} == {"a": 0, "b": 1, "c": 0, "d": None}


def test_component_rules_and_digest(spark):
    parts = spark.createDataFrame([("x", "1", "Bad", "mit"), ("y", "", "ok", "GPL"), ("z", None, "ok", "mit")], "name string, version string, origin string, license string")
    rules = {"origins": ("bad",), "licenses": ("gpl",), "denied": ("Z",)}
    got = sorted(tuple(r) for r in L.component_findings(parts, **rules).collect())
    assert got == [("x", "prohibited_origin", True), ("y", "disallowed_license", True), ("y", "unpinned_version", True), ("z", "denylisted", True), ("z", "unpinned_version", True)]
    a, b = L.gate(parts, pinned=False).first(), L.gate(parts.orderBy("name", ascending=False), pinned=False).first()
    assert a == b and a.admit and a.advisory == 2 and L.gate(parts.limit(0)).first().components == 0


def readings(spark, rows):
    return spark.createDataFrame([(i, "tanks", "n", dt.date(2026, 1, 1) + dt.timedelta(days=d), p, x, s) for i, (d, p, x, s) in enumerate(rows)], "seq long, category string, side string, date date, produced double, lost double, inventory double")


def test_trajectory_is_anchored_at_the_first_inventory(spark):
    got = T.trajectory(readings(spark, [(0, 5.0, 1.0, None), (1, 0.0, 2.0, 100.0), (1, 0.0, 1.0, 90.0), (2, 0.0, 500.0, None)])).orderBy("date").collect()
    assert [r.stock for r in got] == [93.0, 90.0, 0.0]


def test_depletion_is_by_current_over_slope(spark):
    down = readings(spark, [(d, 0.0, 10.0, 100.0 if d == 0 else None) for d in range(5)])
    r = T.project(down).first()
    assert (r.current, r.slope, r.days_left) == (60.0, -10.0, 6.0) and r.depletion == dt.date(2026, 1, 11)
    up = T.project(readings(spark, [(0, 5.0, 0.0, None), (1, 5.0, 0.0, None)])).first()
    assert up.days_left is None and up.depletion is None
    none = T.attrition_ratio(readings(spark, [(0, 0.0, 4.0, None)])).first()
    assert none.ratio is None and none.sustainable is False
