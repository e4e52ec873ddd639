"""Logs and inventories: telemetry replay, ride quality, supply status, load plans, and component rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame, channel: str | None = None, t0: float | None = None, t1: float | None = None) -> DataFrame:
    """Records in order of time, then sequence; of one channel and a closed span of time, if given."""
    if channel is not None:
        log = log.where(F.col("channel") == channel)
    if t0 is not None:
        log = log.where(F.col("t") >= t0)
    if t1 is not None:
        log = log.where(F.col("t") <= t1)
    return log.orderBy("t", "seq")


def after_action(log: DataFrame) -> DataFrame:
    """Records, start, end and duration of each channel, and of all (channel null)."""
    return log.rollup("channel").agg(F.count("*").alias("records"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), (F.max("t") - F.min("t")).alias("duration_s"))


LIMITS = {"accel": 1.2, "lateral": 1.2, "jerk": 1.0, "tilt": 12.0, "speed": 6.0}


def ride_verdicts(samples: DataFrame, limits: dict[str, float] | None = None, key: str = "vehicle") -> DataFrame:
    """Each sample against a gentle envelope: jerk from the sample before, the worst axis and ratio, severity, quality.

    samples: key, t, accel, lateral, tilt, speed."""
    limits = {**LIMITS, **(limits or {})}
    w = Window.partitionBy(key).orderBy("t")
    gap = F.greatest(F.lit(1e-6), F.col("t") - F.lag("t").over(w))
    jerk = F.coalesce(F.abs(F.col("accel") - F.lag("accel").over(w)) / gap, F.lit(0.0))
    rows = samples.withColumn("jerk", jerk)
    ratio = [F.abs(F.col(a)) / c if c > 0 else F.lit(0.0) for a, c in limits.items()]
    worst = F.greatest(*ratio)
    axis = F.coalesce(*[F.when((r == worst) & (worst > 0), F.lit(a)) for a, r in zip(limits, ratio, strict=True)])
    band = F.when(worst <= 1.0, "ok").when(worst <= 1.25, "minor").when(worst <= 1.6, "moderate").otherwise("severe")
    over = F.greatest(F.lit(0.0), worst - 1.0)
    return rows.select(key, "t", "jerk", axis.alias("worst_axis"), worst.alias("worst_ratio"), band.alias("severity"), (1.0 / (1.0 + over * over)).alias("quality"))


def ride_report(verdicts: DataFrame, key: str = "vehicle") -> DataFrame:
    """Samples, mean quality, exceedances by severity, and whether none is worse than minor."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    got = verdicts.groupBy(key).agg(F.count("*").alias("samples"), F.avg("quality").alias("ride_quality"), count("minor"), count("moderate"), count("severe"))
    return got.withColumn("acceptable", (F.col("moderate") == 0) & (F.col("severe") == 0))


def effective_days() -> Column:
    """Days that the stock lasts at its burn; null without any."""
    return F.when(F.col("burn") > 0, F.col("days_on_hand") / F.col("burn"))


def stock_status(stocks: DataFrame, horizon: float = 7.0) -> DataFrame:
    """black, critical, reorder or green, days to the reorder trigger, and whether either comes within the horizon.

    stocks: item, days_on_hand, burn, trigger_days, critical_days."""
    days = effective_days()
    status = F.when(days <= 0, "black").when(days <= F.col("critical_days"), "critical").when(days <= F.col("trigger_days"), "reorder").otherwise("green")
    left = F.when(F.col("burn") > 0, F.greatest(F.lit(0.0), (F.col("days_on_hand") - F.col("trigger_days")) / F.col("burn")))
    return stocks.select("item", "days_on_hand", days.alias("effective_days"), status.alias("status"), left.alias("days_to_trigger"), F.coalesce(left <= horizon, F.lit(False)).alias("triggers"), F.coalesce(days <= horizon, F.lit(False)).alias("runs_out"))


#: Weight in kg and volume in cubic metres for each person and day, by class of supply.
PER_PERSON_DAY = {"I": (2.0, 0.006), "WATER": (7.5, 0.0075), "III": (1.0, 0.0012), "V": (3.0, 0.004), "VIII": (0.2, 0.0004), "IX": (0.3, 0.0005)}


def requirement(units: DataFrame, classes: tuple[str, ...] = tuple(PER_PERSON_DAY)) -> DataFrame:
    """Person-days, weight and volume of each class for units (unit, strength, days)."""
    per = F.array(*[F.struct(F.lit(c).alias("item"), F.lit(PER_PERSON_DAY[c][0]).alias("w"), F.lit(PER_PERSON_DAY[c][1]).alias("v")) for c in classes if c in PER_PERSON_DAY])
    need = F.ceil(F.greatest(F.lit(0), F.col("strength")) * F.greatest(F.lit(0.0), F.col("days"))).cast("long")
    rows = units.select("unit", need.alias("person_days"), F.explode(per).alias("c"))
    return rows.select("unit", "c.item", "person_days", (F.col("person_days") * F.col("c.w")).alias("weight"), (F.col("person_days") * F.col("c.v")).alias("volume"))


def load_rollup(placed: DataFrame) -> DataFrame:
    """Weight, volume and lines of each vehicle, and its centre of gravity. placed: vehicle, station, weight, volume."""
    got = placed.groupBy("vehicle").agg(F.count("*").alias("lines"), F.sum("weight").alias("weight"), F.sum("volume").alias("volume"), F.sum(F.col("weight") * F.col("station")).alias("_moment"))
    return got.select("vehicle", "lines", "weight", "volume", F.when(F.col("weight") > 0, F.col("_moment") / F.col("weight")).otherwise(0.0).alias("cg"))


PLACED = "vehicle string, item string, weight double, volume double, bay int"


def pack(items: DataFrame, bays: list[tuple[float, float]]) -> DataFrame:
    """Greedy packing of each vehicle's items, heaviest first, into the bay with the most weight to spare that holds them;
    bay null where none does. bays: (weight, volume) limits.

    Placing is sequential for each vehicle, so items are dealt by vehicle, sorted, and read as a stream: a task holds the
    loads of one vehicle's bays, whatever the number of vehicles or items."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, weight, volume = None, [], []
        for part in frames:
            out = []
            for name, w, v in zip(part["vehicle"], part["weight"], part["volume"], strict=True):
                if current is None or name != current[0]:
                    current, weight, volume = (name,), [0.0] * len(bays), [0.0] * len(bays)
                fit = [i for i, (x, y) in enumerate(bays) if weight[i] + w <= x + 1e-9 and volume[i] + v <= y + 1e-9]
                at = max(fit, key=lambda i: (bays[i][0] - weight[i], -i)) if fit else None
                if at is not None:
                    weight[at] += w
                    volume[at] += v
                out.append(at)
            yield part.assign(bay=pd.array(out, dtype="Int32"))

    rows = items.select("vehicle", "item", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("volume", F.lit(0.0)).alias("volume"))
    return rows.repartition("vehicle").sortWithinPartitions("vehicle", F.desc("weight"), "item").mapInPandas(run, PLACED)


def component_findings(parts: DataFrame, origins: tuple[str, ...] = (), licenses: tuple[str, ...] = (), denied: tuple[str, ...] = (), pinned: bool = True) -> DataFrame:
    """component, rule, blocking: prohibited origins, disallowed licenses, denied names, and versions that aren't pinned."""
    has = lambda c, bad: F.lower(F.coalesce(c, F.lit(""))).isin(*[x.lower() for x in bad]) if bad else F.lit(False)
    rules = [("prohibited_origin", has("origin", origins), True), ("disallowed_license", has("license", licenses), True), ("denylisted", has("name", denied), True), ("unpinned_version", F.coalesce("version", F.lit("")) == "", pinned)]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(block).alias("blocking"))) for rule, test, block in rules]))
    return parts.select(F.col("name").alias("component"), F.explode(found).alias("f")).select("component", "f.rule", "f.blocking")


def gate(parts: DataFrame, **rules) -> DataFrame:
    """One row: components, findings by weight, whether to admit, and a digest that doesn't depend on their order."""
    found = component_findings(parts, **rules).agg(F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("advisory"))
    one = F.sha2(F.concat_ws("|", "name", F.coalesce("version", F.lit("unpinned")), "origin", "license"), 256)
    # A digest of a sum of digests: the sum takes rows in any order, and no task holds them all.
    whole = parts.agg(F.count("*").alias("components"), F.sum(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)")).alias("_s"))
    return whole.crossJoin(F.broadcast(found)).select("components", "blocking", "advisory", (F.col("blocking") == 0).alias("admit"), F.substring(F.sha2(F.coalesce(F.col("_s").cast("string"), F.lit("")), 256), 1, 16).alias("digest"))


def occupancy(litters: DataFrame, required: int = 2) -> DataFrame:
    """Of each vehicle: positions, loaded, secured, faults, and whether enough are loaded and all of them secured."""
    loaded, secured = F.count_if(F.col("state").isin("loaded", "secured")), F.count_if(F.col("state") == "secured")
    got = litters.groupBy("vehicle").agg(F.count("*").alias("positions"), loaded.alias("loaded"), secured.alias("secured"), F.count_if(F.col("state") == "fault").alias("faults"))
    return got.withColumn("enough", (F.col("loaded") >= required) & (F.col("faults") == 0)).withColumn("all_secured", (F.col("loaded") == F.col("secured")) & (F.col("loaded") > 0))
