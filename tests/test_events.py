"""Detectors at, below and above their thresholds, links and graphs against brute force, and order independence."""

import datetime as dt
import math
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fieldglass.functions.fixed import REPORT_STOPWORDS
from fieldglass.operators import aggregates as A
from fieldglass.operators import detect as D
from fieldglass.operators import flux as W
from fieldglass.operators import graph as G
from fieldglass.operators import link as L
from fieldglass.operators import series as S

SCHEMA = "seq long, date date, event_type string, actor1 string, actor2 string, country string, region string, location string, lat double, lon double, magnitude int, source string, notes string"
END = dt.date(2026, 6, 30)


def event(seq, days_ago, **more):
    base = {"seq": seq, "date": END - dt.timedelta(days=days_ago), "event_type": "battle", "actor1": "A", "actor2": "B", "country": "X", "region": "", "location": "P", "lat": None, "lon": None, "magnitude": 0, "source": "S", "notes": ""}
    return tuple((base | more).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def daily(per_window):
    """So many events in each 7-day window, the latest first; the last one on the last day of all."""
    out = []
    for k, n in enumerate(per_window):
        out += [event(len(out) + i, 7 * k + (0 if k == 0 and i == 0 else i % 7)) for i in range(n)]
    return out


@pytest.mark.parametrize("counts,spike,sustained", [((9, 3, 3, 3, 3), True, True), ((5, 3, 3, 3, 3), True, True), ((4, 3, 3, 3, 3), False, False), ((3, 3, 3, 3, 3), False, False), ((6, 4, 4, 4, 4), False, True), ((5, 4, 4, 4, 4), False, False), ((1, 0, 0, 0, 0), False, False), ((2, 0, 0, 0, 0), True, False)])
def test_volume_detectors(spark, counts, spike, sustained):
    ev = frame(spark, daily(counts))
    found = {r.detector for r in D.volume_alerts(D.scoped(ev, "country")).collect()}
    assert ("spike" in found) == spike and ("sustained-trend" in found) == sustained


@pytest.mark.parametrize("deaths,base,want", [(6, 0, True), (3, 0, True), (2, 0, False), (6, 1, True), (5, 1, False)])
def test_lethality_shift(spark, deaths, base, want):
    rows = [event(i, i, magnitude=deaths // 3 + (i < deaths % 3)) for i in range(3)] + [event(10 + i, 8 + i, magnitude=base) for i in range(4)]
    found = {r.detector for r in D.volume_alerts(D.scoped(frame(spark, rows), "country")).collect()}
    assert ("lethality-shift" in found) == want


def test_new_actor_needs_a_baseline(spark):
    now = [event(1, 0, actor1="New", actor2="A")]
    assert D.actor_alerts(D.scoped(frame(spark, now), "country")).count() == 0
    got = D.actor_alerts(D.scoped(frame(spark, [*now, event(2, 9), event(3, 40, actor1="New")]), "country")).collect()
    assert [(r.detector, r.evidence, r.score, r.volume) for r in got] == [("new-actor", "New", 1.7, 1)]


@pytest.mark.parametrize("now,last,want", [(3, 1, True), (2, 1, False), (4, 2, True), (3, 2, False), (5, 0, False)])
def test_geo_spread(spark, now, last, want):
    rows = [event(i, 0, location=f"n{i}") for i in range(now)] + [event(50 + i, 8, location=f"n{i}") for i in range(last)] + [event(99, 20, location="n0")]
    found = {r.detector for r in D.place_alerts(D.scoped(frame(spark, rows), "country")).collect()}
    assert ("geo-spread" in found) == want


@pytest.mark.parametrize("now,base,want", [(4, 0, True), (3, 0, False), (4, 1, True), (5, 2, False)])
def test_new_hotspot(spark, now, base, want):
    rows = [event(i, 0) for i in range(now)] + [event(50 + i, 10) for i in range(base)]
    found = {r.detector for r in D.place_alerts(D.scoped(frame(spark, rows), "country")).collect()}
    assert ("new-hotspot" in found) == want


def test_floor_and_as_of(spark):
    ev = frame(spark, daily((5, 3, 3, 3, 3)))
    every, some = D.detect(ev).count(), D.detect(ev, min_severity="medium").count()
    assert 0 < some < every and D.detect(ev, min_severity="nope").count() == every
    assert D.detect(ev, as_of=END - dt.timedelta(days=7)).where("detector = 'spike'").count() == 0


def test_results_do_not_depend_on_order(spark):
    rows = daily((12, 3, 5, 2, 4))
    ev = frame(spark, rows)
    for run in (D.detect, D.posture, lambda e: A.hotspots(e, 5), lambda e: S.dense_daily(e), W.windows):
        want = sorted(map(str, run(ev).collect()))
        for seed in (1, 2):
            shuffled = rows[:]
            random.Random(seed).shuffle(shuffled)
            assert sorted(map(str, run(frame(spark, shuffled).repartition(3)).collect())) == want


def test_undated_blank_and_empty(spark):
    rows = [event(1, 0, date=None), event(2, 0, country="", region="", location=""), event(3, 1, actor1=" ", actor2=None), event(4, 2, actor1="Z", actor2="Z")]
    ev = frame(spark, rows)
    assert A.summary(ev).first().events == 4 and A.timeline(ev).count() == 3
    assert {r.actor for r in A.actor_nodes(ev).collect()} == {"A", "B", "Z"} and A.actor_edges(ev).count() == 1
    assert "(unknown)" in {r.scope for r in D.scoped(ev, "country").collect()}
    none = ev.limit(0)
    for run in (D.detect, D.posture, S.dense_daily, lambda e: S.peaks(S.dense_daily(e)), lambda e: S.escalation_index(e), S.tempo_board, L.clusters, L.merge, lambda e: W.structure(W.windows(e)), A.cooccurrence):
        assert run(none).count() == 0


def scattered(seed, n=160):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = r.choice([(0, 179.99), (0, -179.99), (60, 10), (89.95, 0), (89.95, 170), (-45, 0), (10, 10)])
        out.append(event(i, r.randrange(25), lat=lat + r.uniform(-0.2, 0.2) if abs(lat) < 89 else lat, lon=((lon + r.uniform(-0.2, 0.2) + 180) % 360) - 180 if r.random() < 0.95 else None, event_type=r.choice(["battle", "riots", "other"]), country=r.choice(["X", "Y", ""]), location=r.choice(["town", "Town north", "hill", ""]), notes=r.choice(["convoy hit near bridge", "convoy hit by bridge", "market closed", ""]), actor1=r.choice(["A", "B", "C"]), actor2=r.choice(["A", "D", ""])))
    return out


def km(a, b):
    x, y = math.radians(a[8]), math.radians(b[8])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[9] - a[9]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def gap(a, b):
    return abs((a[1] - b[1]).days)


@pytest.mark.parametrize("seed,radius,days", [(1, 12.0, 3), (2, 30.0, 1), (3, 3.0, 6)])
def test_near_pairs_match_brute_force(spark, seed, radius, days):
    rows = scattered(seed)
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if None not in (a[9], b[9]) and gap(a, b) <= days and km(a, b) <= radius}
    assert {tuple(r) for r in L.near_pairs(frame(spark, rows), radius, days).collect()} == want


def brute_duplicate(a, b, days, radius, threshold):
    if gap(a, b) > days:
        return False
    if None not in (a[9], b[9]):
        place = km(a, b) <= radius
    else:
        p, q = (a[7] or a[6]).lower(), (b[7] or b[6]).lower()
        c, d = a[5].lower(), b[5].lower()
        place = False if c and d and c != d else (p in q or q in p) if p and q else c == d and c != ""
    stop = set(REPORT_STOPWORDS)
    words = lambda e: {w for w in " ".join([e[12], e[3], e[4], e[7], e[6]]).lower().split() if len(w) >= 2 and w not in stop}
    x, y = words(a), words(b)
    alike = (len(x & y) / len(x | y) if x | y else 0.0) >= threshold or (a[2] == b[2] and a[2] != "other")
    return place and alike


@pytest.mark.parametrize("seed", [4, 5])
def test_duplicates_match_brute_force(spark, seed):
    rows = scattered(seed, 120)
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if brute_duplicate(a, b, 1, 15.0, 0.5)}
    assert {tuple(r) for r in L.duplicate_pairs(frame(spark, rows)).collect()} == want
    up = {r[0]: r[0] for r in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert {r.seq: r.incident for r in L.incident_groups(frame(spark, rows)).collect()} == {i: find(i) for i in up}


def test_merge_folds_reports(spark):
    rows = [event(1, 1, magnitude=3, notes="convoy hit near bridge", source="W", lat=1.0, lon=1.0, event_type="other", location="Town"), event(2, 0, magnitude=5, notes="convoy hit near the old bridge", source="R", lat=1.0, lon=1.01, event_type="other", location="Town"), event(3, 0, lat=50.0, lon=50.0)]
    got = L.merge(frame(spark, rows)).orderBy("incident").collect()
    assert len(got) == 2 and (got[0].reports, got[0].magnitude, got[0].notes, got[0].source) == (2, 5, "convoy hit near the old bridge", "R | W")
    report = L.merge_report(L.merge(frame(spark, rows))).first()
    assert tuple(report) == (3, 2, 1, 2)


def test_merge_unites_tags_and_counts_repeated_rows_once(spark):
    rows = [event(1, 1, notes="convoy hit near bridge", lat=1.0, lon=1.0, event_type="battle"), event(2, 1, notes="convoy hit", lat=1.0, lon=1.0, event_type="battle"), event(9, 20, notes="lone")]
    ev = frame(spark, rows + rows[:1])
    ev = ev.withColumns({"id": F.concat(F.lit("i"), "seq"), "source_url": F.when(F.col("seq") == 2, "http://b").otherwise(F.lit("")), "tags": F.when(F.col("seq") == 1, F.array(F.lit("x"), F.lit("y"))).when(F.col("seq") == 2, F.array(F.lit("y")))})
    got = L.merge(ev).orderBy("incident").collect()
    assert [(r.incident, r.reports, r.source_url, r.tags) for r in got] == [(1, 2, "http://b", ["merged:2", "src:i1", "src:i2", "x", "y"]), (9, 1, "", ["merged:1"])]
    assert L.clusters(ev, min_size=2).first()["size"] == 2


def test_hot_place_links_by_classes(spark):
    same = [event(i, 1, lat=5.0, lon=5.0, event_type="battle", notes="same words") for i in range(400)]
    far = [event(1000, 1, lat=5.05, lon=5.0, event_type="battle", notes="other report")]
    blank = [event(2000 + i, 1, country="", location="Old Town", lat=None, lon=None, event_type="battle") for i in range(30)] + [event(3000, 2, country="Mali", location="town", lat=None, lon=None, event_type="battle")]
    ev = frame(spark, same + far + blank)
    got = {r.seq: r.incident for r in L.incident_groups(ev).collect()}
    assert all(got[i] == 0 for i in [*range(400), 1000]) and all(got[2000 + i] == 2000 for i in range(30)) and got[3000] == 2000
    assert L.duplicate_links(ev).count() < 500


def test_events_of_one_spot_and_type_are_no_pairs(spark):
    hot = [event(i, 1, lat=5.0, lon=5.0, event_type="battle", location="", notes=f"w{i}a w{i}b w{i}c") for i in range(300)]
    near = [event(1000, 2, lat=5.05, lon=5.0, event_type="battle", location="", notes="all else")]
    ev = frame(spark, hot + near)
    assert L.duplicate_links(ev).count() < 400 and L.duplicate_pairs(ev).count() == 301 * 300 // 2
    assert {r.incident for r in L.incident_groups(ev).collect()} == {0}


def test_event_components_link_spots(spark):
    ev = frame(spark, [event(i, 1 + i % 2, lat=5.0, lon=5.0) for i in range(300)] + [event(1000, 2, lat=80.0, lon=5.0)])
    links = L.near_links(ev, 8.0, 3)
    assert links.count() < 400 and L.near_pairs(ev, 8.0, 3).count() == 300 * 299 // 2
    assert {(r.node, r.component) for r in L.connected_components(links).collect()} == {(i, 0) for i in range(1, 300)}


def spread(seed, n, types):
    """Events of few spots and days, with words of a few vocabularies; some have no type, words or seq of their own."""
    r = random.Random(seed)
    words = lambda: " ".join(r.choice(["a1 b1 c1 d1", "a1 b1 c1 e1", "f1 g1", f"x{r.randrange(9)}y z{r.randrange(99)}z", ""]) for _ in range(r.randrange(3)))
    return [event(r.randrange(n - 9) if i % 50 == 0 else i, 1 + r.randrange(4), lat=r.choice([5.0, 5.05]), lon=5.0, event_type=r.choice(types), actor1=r.choice(["AB", "CD", ""]), actor2="", location="", region="", notes=words()) for i in range(n)]


@pytest.mark.parametrize("size,alone", [(512, 1 << 16), (512, 0), (7, 1 << 16), (7, 20)])
def test_pairs_of_blocks_match_brute_force(spark, monkeypatch, size, alone):
    monkeypatch.setattr(L, "BLOCK", size)
    monkeypatch.setattr(L, "ALONE", alone)
    rows = spread(7, 200, ["battle", "riots", "other", "other"])
    pairs = [(min(a[0], b[0]), max(a[0], b[0]), a, b) for a, b in combinations(rows, 2) if a[0] != b[0]]
    assert {tuple(x) for x in L.duplicate_pairs(frame(spark, rows)).collect()} == {(i, j) for i, j, a, b in pairs if brute_duplicate(a, b, 1, 15.0, 0.5)}
    assert L.duplicate_pairs(frame(spark, rows)).count() == len({(i, j) for i, j, a, b in pairs if brute_duplicate(a, b, 1, 15.0, 0.5)})
    assert sorted(tuple(x) for x in L.near_pairs(frame(spark, rows), 8.0, 2).collect()) == sorted((i, j) for i, j, a, b in pairs if gap(a, b) <= 2 and km(a, b) <= 8.0)


def test_pairs_are_made_of_blocks_not_joined(spark):
    ev = frame(spark, [event(i, 1, lat=5.0, lon=5.0, notes=f"w{i}a") for i in range(600)])
    assert L._met(ev, F.col("seq"), 8.0, 3).count() == 3
    plan = L.duplicate_pairs(ev)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "Aggregate" not in plan


def test_pairs_keep_the_type_of_seq(spark):
    ev = frame(spark, [event(i, 1, lat=5.0, lon=5.0, event_type="battle") for i in (10, 9)]).withColumn("seq", F.concat(F.lit("s"), "seq"))
    assert [tuple(r) for r in L.duplicate_pairs(ev).collect()] == [tuple(r) for r in L.near_pairs(ev).collect()] == [("s10", "s9")]


def graph(seed, n=14, p=0.25):
    r = random.Random(seed)
    return [(f"n{i:02d}", f"n{j:02d}", r.randrange(1, 5)) for i in range(n) for j in range(i + 1, n) if r.random() < p], [f"n{i:02d}" for i in range(n + 1)]


def frames(spark, ties, names):
    return spark.createDataFrame([(n,) for n in names], "actor string"), spark.createDataFrame(ties, "a string, b string, weight long")


def shortest(ties, names, weighted):
    inf = float("inf")
    d = {(x, y): 0.0 if x == y else inf for x in names for y in names}
    for a, b, w in ties:
        d[a, b] = d[b, a] = 1 / w if weighted else 1.0
    for k in names:
        for x in names:
            for y in names:
                d[x, y] = min(d[x, y], d[x, k] + d[k, y])
    return d


@pytest.mark.parametrize("seed,weighted", [(1, False), (2, True), (3, False)])
def test_closeness_and_betweenness(spark, seed, weighted):
    ties, names = graph(seed)
    nodes, edges = frames(spark, ties, names)
    d, n = shortest(ties, names, weighted), len(names)
    got = {r.actor: r.score for r in G.closeness(nodes, edges, weighted).collect()}
    for x in names:
        far = [d[x, y] for y in names if y != x and d[x, y] < float("inf")]
        want = (len(far) / sum(far)) * (len(far) / (n - 1)) if far else 0.0
        assert got[x] == pytest.approx(want)
    near = defaultdict(dict)
    for a, b, w in ties:
        near[a][b] = near[b][a] = 1 / w if weighted else 1.0

    def paths(x, y):
        if x == y:
            return [[y]]
        return [[x, *p] for z, w in near[x].items() if abs(w + d[z, y] - d[x, y]) < 1e-12 for p in paths(z, y)]

    want = dict.fromkeys(names, 0.0)
    for x, y in combinations(names, 2):
        if d[x, y] < float("inf"):
            found = paths(x, y)
            for p in found:
                for v in p[1:-1]:
                    want[v] += 1 / len(found)
    got = {r.actor: r.score for r in G.betweenness(nodes, edges, weighted).collect()}
    assert got == pytest.approx({v: x / ((n - 1) * (n - 2) / 2) for v, x in want.items()})


@pytest.mark.parametrize("seed", [1, 4])
def test_cores_components_and_communities(spark, seed):
    ties, names = graph(seed, p=0.2)
    nodes, edges = frames(spark, ties, names)
    left, core, k = {frozenset(t[:2]) for t in ties}, dict.fromkeys(names, 0), 1
    while left:
        while True:
            deg = defaultdict(int)
            for e in left:
                for v in e:
                    deg[v] += 1
            keep = {e for e in left if all(deg[v] >= k for v in e)}
            if keep == left:
                break
            left = keep
        for e in left:
            for v in e:
                core[v] = k
        k += 1
    assert {r.actor: r.core for r in G.coreness(nodes, edges).collect()} == core
    d = shortest(ties, names, False)
    assert {r.actor: r.component for r in G.components(nodes, edges).collect()} == {x: min(y for y in names if d[x, y] < float("inf")) for x in names}
    found = {r.actor: r.community for r in G.communities(nodes, edges).collect()}
    assert set(found) == set(names) and all(d[x, found[x]] < float("inf") for x in names)


def test_pagerank_and_eigenvector(spark):
    import numpy as np

    ties, names = graph(6)
    nodes, edges = frames(spark, ties, names)
    n, at = len(names), {x: i for i, x in enumerate(names)}
    m = np.zeros((n, n))
    for a, b, w in ties:
        m[at[a], at[b]] = m[at[b], at[a]] = w
    out = m.sum(axis=1)
    p = np.full(n, 1 / n)
    for _ in range(300):
        flow = sum(p[i] * m[i] / out[i] for i in range(n) if out[i])
        p = 0.15 / n + 0.85 * (flow + p[out == 0].sum() / n)
    got = {r.actor: r.score for r in G.pagerank(nodes, edges, rounds=60).collect()}
    np.testing.assert_allclose([got[x] for x in names], p / p.sum(), atol=1e-6)
    v = np.full(n, n**-0.5)
    for _ in range(15):
        v = m @ v
        v /= np.sqrt((v**2).sum())
    got = {r.actor: r.score for r in G.eigenvector(nodes, edges, rounds=15).collect()}
    np.testing.assert_allclose([got[x] for x in names], v, atol=1e-9)


def test_path_measures_refuse_large_graphs(spark, monkeypatch):
    ties, names = graph(1)
    monkeypatch.setattr(G, "MAX_LOCAL_EDGES", 3)
    with pytest.raises(ValueError, match="too many for path measures"):
        G.closeness(*frames(spark, ties, names))
    with pytest.raises(ValueError, match="unknown metric"):
        G.ranking(*frames(spark, ties, names), metric="nope")


def test_flux_finds_who_comes_and_goes(spark):
    rows = [event(1, 20, actor1="old", actor2="A"), event(2, 20), event(3, 10), event(4, 0), event(5, 0, actor1="new", actor2="A"), event(6, 0, actor1="new", actor2="B")]
    placed = W.windows(frame(spark, rows), 7)
    paths = W.trajectories(placed)
    assert [r.actor for r in W.emerging(paths).collect()] == ["new"] and "old" in {r.actor for r in W.departed(paths).collect()}
    assert {(r.a, r.b) for r in W.persistent_ties(placed).collect()} == {("A", "B")} and {(r.a, r.b) for r in W.emerging_ties(placed).collect()} == {("A", "new"), ("B", "new")}


def test_filters_reach_the_scan(spark, tmp_path):
    frame(spark, daily((3, 3))).write.parquet(f"{tmp_path}/ev")
    plan = A.timeline(A.within(spark.read.parquet(f"{tmp_path}/ev"), country="X", as_of=END))._jdf.queryExecution().executedPlan().toString()
    pushed, read = plan.split("PushedFilters: ")[1].split("ReadSchema: ")
    assert "EqualTo(country,X)" in pushed and "LessThanOrEqual(date," in pushed and "notes" not in read
