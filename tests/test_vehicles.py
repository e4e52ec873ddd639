import math
import random

import pytest

from pyspark.sql import functions as F

from fieldglass.operators import vehicles as V


def test_bearers(spark):
    bearers = spark.createDataFrame([("a", "sat", 100.0, 600.0, True, 0.2, 1000.0), ("a", "uhf", 50.0, 20.0, True, 0.6, 30.0), ("a", "lte", 900.0, 40.0, False, 0.1, 99.0), ("a", "wifi", 500.0, 5.0, True, 0.9, 1.0)], "vehicle string, name string, bandwidth double, latency double, available boolean, signature double, reach_km double")
    needs = [(1, "a", 0.0, 1e9, 0.0, "low_signature"), (2, "a", 0.0, 1e9, 0.0, "bandwidth"), (3, "a", 0.0, 1e9, 10.0, "latency"), (4, "a", 800.0, 1e9, 0.0, "bandwidth"), (5, "b", 0.0, 1e9, 0.0, "latency"), (6, "a", 0.0, 30.0, 0.0, "low_signature"), (7, "a", 0.0, 1e9, 0.0, "fastest")]
    got = V.choose_bearers(spark.createDataFrame(needs, "need int, vehicle string, min_bandwidth double, max_latency double, range_km double, prefer string"), bearers)
    assert {r.need: r.bearer for r in got.collect()} == {1: "sat", 2: "wifi", 3: "uhf", 4: None, 5: None, 6: "uhf", 7: None}


def test_needs_meet_few_bearers(spark):
    r = random.Random(5)
    have = [("v", f"b{i}", float(r.randrange(40)), float(r.randrange(20)), r.random() > 0.1, r.randrange(8) / 8, float(r.randrange(10))) for i in range(1500)]
    have += [("v", None, 39.0, 0.0, True, 0.0, 2.0), ("v", "nan", float("nan"), 0.0, True, 1.0, 2.0), ("v", "unsure", 39.0, 0.0, None, 0.0, 9.0), ("w", "far", 1.0, 1.0, True, 0.0, None)]
    bearers = spark.createDataFrame(have, "vehicle string, name string, bandwidth double, latency double, available boolean, signature double, reach_km double")
    prefer = ["low_signature", "bandwidth", "latency", "none", None]
    asked = [(i, r.choice("vvvw"), float(r.randrange(3, 45)), float(r.randrange(22)), float(r.randrange(3, 12)), r.choice(prefer)) for i in range(300)]
    needs = spark.createDataFrame(asked, "need int, vehicle string, min_bandwidth double, max_latency double, range_km double, prefer string")
    order = {"low_signature": lambda b: (b[5], b[3], -b[2], b[1]), "bandwidth": lambda b: (-b[2], b[5], b[3], b[1]), "latency": lambda b: (b[3], b[5], -b[2], b[1])}
    want = {}
    for n, vehicle, wide, late, away, p in asked:
        fit = [b for b in have if b[0] == vehicle and b[1] and b[4] and b[2] >= wide and b[3] <= late and b[6] is not None and b[6] >= away and p in order]
        want[n] = min(fit, key=order[p])[1] if fit else None
    assert {x.need: x.bearer for x in V.choose_bearers(needs, bearers).collect()} == want
    b = bearers.where("available AND name <> 'nan'").selectExpr("vehicle", "name", "bandwidth AS bw", "latency AS ms", "signature AS sig", "reach_km")
    assert V._ahead(b, {"latency": F.struct(F.col("ms").alias("x"), F.col("sig").alias("y"), (-F.col("bw")).alias("z"), F.col("name").alias("n"))}).count() < 300


@pytest.mark.parametrize("seed,floor", [(1, 0.0), (2, 0.3)])
def test_widest_routes_match_brute_force(spark, seed, floor):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    links = [(*r.sample(names, 2), round(r.random(), 2), i) for i in range(16)] + [("n0", "n1", 1.7, 90), ("n2", "n2", 0.9, 91)]
    last = {}
    for a, b, q, _ in links:
        if a != b:
            last[frozenset((a, b))] = min(1.0, q)
    want = {("n0", "n0"): 1.0}
    for _ in names:
        for pair, q in last.items():
            for u, v in (sorted(pair), sorted(pair)[::-1]):
                if q > floor and ("n0", u) in want:
                    want["n0", v] = max(want.get(("n0", v), 0.0), min(q, want["n0", u]))
    df = spark.createDataFrame(links, "a string, b string, quality double, seq int")
    got = V.widest_routes(df, spark.createDataFrame([("n0",)], "src string"), floor).collect()
    assert {(x.src, x.node): x.bottleneck for x in got} == want
    for x in got:
        assert x.path[0] == x.src and x.path[-1] == x.node and x.hops == len(x.path) - 1
        assert x.bottleneck == min([1.0, *(last[frozenset(e)] for e in zip(x.path, x.path[1:], strict=False))])


def test_navigation(spark):
    none = (None, None, None, None)
    steps = [("d", 1, 2.0, 0.0, 1.0, *none), ("d", 2, 0.0, math.pi / 2, 1.0, *none), ("d", 3, 3.0, 0.0, 2.0, 2.0, 6.4, 4.0, "gnss"), ("e", 1, 1.0, 0.0, -5.0, 0.0, 0.0, 0.0, "odd")]
    got = {(r.drive, r.seq): r for r in V.navigate(spark.createDataFrame(steps, "drive string, seq int, speed double, heading_rate double, dt double, fix_x double, fix_y double, fix_variance double, fix_source string")).collect()}
    a, b, c, e = (got[k] for k in (("d", 1), ("d", 2), ("d", 3), ("e", 1)))
    assert (a.x, a.y, a.variance, a.mode) == (2.0, 0.0, 25.5, "dead-reckoning") and b.heading == pytest.approx(math.pi / 2)
    gain = 27.0 / 31.0
    assert c.y == pytest.approx(6 + gain * 0.4) and c.variance == pytest.approx((1 - gain) * 27) and c.mode == "gnss" and c.quality == pytest.approx(1 / (1 + c.variance / 100))
    assert e.x == 0 and e.variance < 1e-5 and e.mode == "dead-reckoning"


def test_terrain_fix_finds_the_place(spark):
    r = random.Random(3)
    grid = [[r.uniform(0, 50) for _ in range(20)] for _ in range(20)]

    def height(x, y):
        i, j = int(x // 10), int(y // 10)
        tx, ty = x / 10 - i, y / 10 - j
        return (grid[j][i] * (1 - tx) + grid[j][i + 1] * tx) * (1 - ty) + (grid[j + 1][i] * (1 - tx) + grid[j + 1][i + 1] * tx) * ty

    samples = [(dx, dy, height(95 + dx, 80 + dy)) for dx in (-12.0, 0.0, 13.0) for dy in (-9.0, 0.0, 14.0)]
    df = spark.createDataFrame([(1, 80.0, 100.0, samples), (2, 80.0, 100.0, [])], "key int, guess_x double, guess_y double, samples array<struct<dx:double,dy:double,height:double>>")
    (got,) = V.terrain_fixes(df, grid).collect()
    assert (got.key, got.x, got.y, got.variance) == (1, 95.0, 80.0, 1.0)
    with pytest.raises(ValueError, match="a grid has"):
        V.terrain_fixes(df, [[1.0, 2.0]])


def image():
    px = [[50.0] * 40 for _ in range(10)]
    for j in (3, 4, 5):
        for i in range(10, 18):
            px[j][i] = 220.0
        for i in range(18, 28):
            px[j][i] = 1.0
    px[0][0] = px[8][30] = px[9][30] = px[9][31] = 220.0
    return px


def test_sonar_contacts(spark):
    df = spark.createDataFrame([(1, image(), 0.1, 0.2, 10.0), (2, [[1.0, 2.0], [1.0]], 0.1, 0.1, 5.0), (3, None, 0.1, 0.1, 5.0), (4, [[7.0] * 5] * 5, 0.1, 0.1, 5.0)], "image int, pixels array<array<double>>, across_m double, along_m double, altitude double")
    found = V.sonar_contacts(df)
    a, b = found.orderBy("contact").collect()
    assert (a.image, a.contact, a["class"]) == (1, 0, "mine_like") and (a.length_m, a.width_m, a.shadow_m) == (pytest.approx(0.8), pytest.approx(0.6), pytest.approx(1.0))
    assert a.height_m == pytest.approx(10 * 1.0 / (1.7 + 1.0)) and a.grazing_deg == pytest.approx(math.degrees(math.atan2(10, 1.7))) and a.along_m == pytest.approx(0.8)
    assert b["class"] == "clutter" and b.shadow_m == 0 and b.height_m == 0 and b.score < a.score
    assert V.contact_summary(found).select("contacts", "mine_like", "clutter").first() == (2, 1, 1)


@pytest.mark.parametrize("seed", range(4))
def test_boxes_match_flood_fill(seed):
    import numpy as np

    r = random.Random(seed)
    x = np.array([[float(r.random() < 0.55) for _ in range(17)] for _ in range(13)])
    left, want = {(j, i) for j in range(13) for i in range(17) if x[j, i] > 0.5}, []
    while left:
        todo, group = [left.pop()], []
        while todo:
            j, i = todo.pop()
            group.append((j, i))
            for n in ((j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        if len(group) >= 3:
            want.append((min(i for _, i in group), min(j for j, _ in group), max(i for _, i in group), max(j for j, _ in group)))
    assert sorted(V.bright_boxes(x, 0.5, 3)) == sorted(want)


def test_searches_of_a_small_file_are_spread(spark, tmp_path):
    from fieldglass.plans import vehicles as P

    for table, rows in (("events", "id AS event_id, 'error' AS event_type, id AS user_id"), ("part", "id AS p_partkey, id AS p_size")):
        spark.range(64).selectExpr(*rows.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    for name in ("terrain_fixes", "sonar_contacts"):
        got = P.Q[name](spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1 and got.count() >= 64
