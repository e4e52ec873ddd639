"""Change detectors over scoped events, ranked alerts, and posture.

All detectors read one aggregate, a row for each scope and period, so a hot scope is combined before the shuffle."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.fixed import ADVISORIES, DRIVER_FLOOR, FACTOR_WEIGHTS, SEVERITIES, TIERS
from .link import Tables

DETECTORS = ("spike", "sustained-trend", "lethality-shift", "new-actor", "geo-spread", "new-hotspot")


def with_age(ev: DataFrame, window: int, baseline_windows: int, as_of: date | None = None) -> DataFrame:
    """Dated events up to the reference day (the last day of all, or ``as_of``), with k: 0 for the recent window, 1 .. K
    for the baseline windows before it; older ones are dropped."""
    ev = ev.where(F.col("date").isNotNull())
    if as_of is not None:
        ev = ev.where(F.col("date") <= F.lit(as_of)).withColumn("_ref", F.lit(as_of))
    else:
        ev = ev.crossJoin(F.broadcast(ev.agg(F.max("date").alias("_ref"))))  # one row
    return ev.withColumn("k", F.floor(F.datediff("_ref", "date") / window).cast("int")).where(F.col("k") <= baseline_windows)


def _alert(df: DataFrame, detector: str, score: Column, volume: Column, evidence: Column) -> DataFrame:
    made = df.select("scope", score.cast("double").alias("score"), volume.cast("long").alias("volume"), evidence.alias("evidence"))
    return made.select("scope", F.lit(detector).alias("detector"), X.severity_from(F.col("score"), F.col("volume")).alias("severity"), "score", "volume", "evidence")


def scoped(ev: DataFrame, scope: str, window: int = 7, baseline_windows: int = 4, as_of: date | None = None) -> DataFrame:
    return with_age(ev, window, baseline_windows, as_of).withColumn("scope", X.scope_key(scope)).where("scope IS NOT NULL")


def volume_alerts(aged: DataFrame, baseline_windows: int = 4) -> DataFrame:
    """spike, sustained-trend and lethality-shift."""
    per = aged.groupBy("scope", "k").agg(F.count("*").alias("n"), F.sum("magnitude").cast("long").alias("m"))
    base = lambda c: [F.coalesce(F.sum(F.when(F.col("k") == i, F.col(c))), F.lit(0)).cast("double") for i in range(1, baseline_windows + 1)]
    of = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    recent, prior, older = F.col("k") == 0, F.col("k") == 1, F.col("k") >= 1
    got = per.groupBy("scope").agg(of("n", recent).alias("recent"), of("n", prior).alias("prior"), of("n", older).alias("base_n"), of("m", recent).alias("mag"), of("m", older).alias("base_m"), F.array(*base("n")).alias("_b"))
    middle = lambda a: (F.get(a, F.lit((baseline_windows - 1) // 2)) + F.get(a, F.lit(baseline_windows // 2))) / 2
    got = got.withColumn("median", middle(F.array_sort("_b"))).withColumn("mad", middle(F.array_sort(F.transform("_b", lambda v: F.abs(v - F.col("median"))))))
    got = got.withColumn("z", X.robust_z(F.col("recent").cast("double"), F.col("median"), F.col("mad"))).where("recent > 0")
    say = F.format_string
    spike = _alert(got.where("z >= 2 AND recent >= 2"), "spike", F.col("z"), F.col("recent"), say("recent=%d prior=%d", "recent", "prior"))
    ratio = F.col("recent") / F.col("prior")
    sustained = _alert(got.where("prior >= 2 AND recent >= 1.5 * prior AND recent >= 4"), "sustained-trend", 1 + (ratio - 1.5), F.col("recent"), say("recent=%d prior=%d", "recent", "prior"))
    lph, base_lph = F.col("mag") / F.col("recent"), F.col("base_m") / F.greatest("base_n", F.lit(1))
    deadly = got.where((F.col("recent") >= 3) & (F.col("base_n") >= 3) & (lph >= 1) & (lph >= 2 * base_lph) & (lph - base_lph >= 1))
    lethal = _alert(deadly, "lethality-shift", F.greatest(F.lit(1.0), 1 + (lph / F.greatest(base_lph, F.lit(0.5)) - 2)), F.col("mag"), say("magnitude=%d events=%d", "mag", "recent"))
    return spike.unionByName(sustained).unionByName(lethal)


def actor_alerts(aged: DataFrame) -> DataFrame:
    """new-actor: actors of the recent window that no baseline event of the scope has."""
    names = F.filter(F.array_distinct(F.array(F.trim(F.coalesce("actor1", F.lit(""))), F.trim(F.coalesce("actor2", F.lit(""))))), lambda a: a != "")
    each = aged.select("scope", "k", F.explode(names).alias("actor")).groupBy("scope", "actor").agg(F.count_if(F.col("k") == 0).alias("now"), F.count_if(F.col("k") > 0).alias("before"))
    has_base = aged.groupBy("scope").agg(F.count_if(F.col("k") > 0).alias("base")).where("base > 0").select("scope")
    new = each.where("before = 0 AND now > 0").groupBy("scope").agg(F.count("*").alias("n"), F.sum("now").alias("hits"), F.array_join(F.slice(F.sort_array(F.collect_set("actor")), 1, 5), ",").alias("names"))
    found = new.join(has_base, "scope")
    return _alert(found, "new-actor", 1 + 0.7 * F.least(F.lit(3), F.col("n")), F.greatest("hits", "n"), F.col("names"))


def place_alerts(aged: DataFrame) -> DataFrame:
    """geo-spread and new-hotspot, from counts for each scope and location."""
    place = X.first_of("location", "region", "country")
    per = aged.select("scope", "k", place.alias("place")).where("place IS NOT NULL").groupBy("scope", "place").agg(F.count_if(F.col("k") == 0).alias("now"), F.count_if(F.col("k") == 1).alias("last"), F.count_if(F.col("k") > 0).alias("base"))
    spread = per.groupBy("scope").agg(F.count_if(F.col("now") > 0).alias("recent"), F.count_if(F.col("last") > 0).alias("prior"), F.sum("now").alias("events"))
    spread = spread.where("prior >= 1 AND recent >= prior + 2 AND recent >= 3")
    geo = _alert(spread, "geo-spread", 1 + 0.5 * (F.col("recent") - F.col("prior")), F.col("events"), F.format_string("recent=%d prior=%d", "recent", "prior"))
    hot = per.where("now >= 4 AND now >= 3 * base AND base <= 1")
    return geo.unionByName(_alert(hot, "new-hotspot", F.greatest(1 + 0.3 * (F.col("now") - 4), F.lit(1.5)), F.col("now"), F.col("place")))


def detect(ev: DataFrame, scope: str = "country", window: int = 7, baseline_windows: int = 4, as_of: date | None = None, min_severity: str = "info") -> DataFrame:
    """All detectors; alerts of at least a severity, an unknown name meaning all."""
    aged = scoped(ev, scope, window, baseline_windows, as_of)
    alerts = reduce(DataFrame.unionByName, [volume_alerts(aged, baseline_windows), actor_alerts(aged), place_alerts(aged)])
    floor = SEVERITIES.index(min_severity) if min_severity in SEVERITIES else 0
    return alerts.where(X.severity_rank(F.col("severity")) >= floor)


def ranked(alerts: DataFrame) -> DataFrame:
    """Alerts with their place in the order by severity, then score."""
    return Tables(alerts.sparkSession).ranked(alerts, X.severity_rank(F.col("severity")).desc(), F.desc("score"), "scope", "detector", "evidence")


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("detector", "severity").agg(F.count("*").alias("alerts"))


def posture(ev: DataFrame, scope: str = "country", window: int = 7, baseline_windows: int = 4, as_of: date | None = None) -> DataFrame:
    """Five factors from 0 to 1, rounded to three places, their weighted score, a tier, and the factors that drive it; for
    scopes with recent events. Drivers and their advice come by falling score of the factor; the board by falling score."""
    aged = scoped(ev, scope, window, baseline_windows, as_of)
    now, place = F.col("k") == 0, X.first_of("location", "region", "country")
    got = aged.groupBy("scope").agg(
        F.count_if(now).alias("recent"), F.count_if(~now).alias("base"), F.coalesce(F.sum(F.when(now, F.col("magnitude"))), F.lit(0)).cast("long").alias("mag"),
        F.count_if(now & F.col("event_type").isin("drone/uas", "explosion/remote")).alias("threats"), F.countDistinct(F.when(now, place)).alias("places"),
    ).where("recent > 0")
    weight = F.element_at(F.create_map(*[x for n, v in zip(SEVERITIES, (0.0, 0.3, 0.6, 0.85, 1.0), strict=True) for x in (F.lit(n), F.lit(v))]), F.col("severity"))
    alerts = detect(ev, scope, window, baseline_windows, as_of).groupBy("scope").agg(F.max(weight).alias("worst"))
    got = got.join(alerts, "scope", "left")
    tempo = F.when(F.col("base") == 0, F.when(F.col("recent") >= 4, 1.0).otherwise(F.col("recent") / 4)).otherwise((F.col("recent") / (F.greatest("base", F.lit(1)) / baseline_windows) - 1) / 2)
    factors = {"tempo": tempo, "lethality": F.col("mag") / F.col("recent") / 5, "escalation": F.coalesce("worst", F.lit(0.0)), "drone_uas": F.col("threats") / F.col("recent"), "spread": (F.col("places") - 1) / 5}
    got = got.select("scope", "recent", "mag", *[F.round(X.clamp01(x), 3).alias(n) for n, x in factors.items()])
    score = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in FACTOR_WEIGHTS.items()])
    got = got.withColumn("score", F.round(score, 6))
    tier = F.when(F.col("score") >= 0.75, TIERS[3]).when(F.col("score") >= 0.5, TIERS[2]).when(F.col("score") >= 0.25, TIERS[1]).otherwise(TIERS[0])
    scored = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(ADVISORIES[n]).alias("advice")) for i, n in enumerate(FACTOR_WEIGHTS)]))
    got = got.withColumn("tier", tier).withColumn("_d", F.filter(scored, lambda f: -f["s"] >= DRIVER_FLOOR))
    out = got.withColumn("drivers", F.array_join(F.transform("_d", lambda f: f["name"]), ",")).withColumn("advisories", F.transform("_d", lambda f: f["advice"]))
    return out.drop("_d").orderBy(F.desc("score"), F.desc("mag"), "scope")


def posture_counts(board: DataFrame) -> DataFrame:
    return board.groupBy("tier").agg(F.count("*").alias("scopes"))
