"""Dense daily series and what is read off them.

A calendar is made for each key from its first to its last day, so gaps count as zero. Series are windowed by key; the
whole corpus as one key gives one row a day, which one task orders whatever the number of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.fixed import LEVELS


def dense_daily(ev: DataFrame, keys: list[str] | None = None, last_shared: bool = False) -> DataFrame:
    """keys, date, i (days from the first), events, magnitude. last_shared: all keys end on the last day of all."""
    keys = keys or []
    days = ev.where(F.col("date").isNotNull()).groupBy(*keys, "date").agg(F.count("*").alias("events"), F.sum("magnitude").cast("long").alias("magnitude"))
    bounds = days.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi")).where("_lo IS NOT NULL")
    if last_shared:
        bounds = bounds.drop("_hi").crossJoin(F.broadcast(days.agg(F.max("date").alias("_hi"))))
    calendar = bounds.select(*keys, "_lo", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return calendar.join(days, [*keys, "date"], "left").select(*keys, "date", F.datediff("date", "_lo").alias("i"), zero("events"), zero("magnitude"))


def moving_average(series: DataFrame, window: int = 7, metric: str = "events", keys: list[str] | None = None) -> DataFrame:
    """Trailing mean; windows at the start are partial."""
    w = Window.partitionBy(*(keys or [])).orderBy("date").rowsBetween(1 - window, 0)
    return series.withColumn("average", F.sum(metric).over(w) / F.count(metric).over(w))


def window_totals(series: DataFrame, window: int = 7, metric: str = "events", keys: list[str] | None = None) -> DataFrame:
    """Sums of windows that don't overlap, aligned to the last day; a partial window at the head is dropped. k: 0 is last."""
    keys = keys or []
    last = F.max("date").over(Window.partitionBy(*keys))
    k = F.floor(F.datediff(last, "date") / window).cast("int").alias("k")
    return series.select(*keys, k, metric).groupBy(*keys, "k").agg(F.sum(metric).alias("total"), F.count("*").alias("_n")).where(F.col("_n") == window).drop("_n")


def with_spread(series: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Adds median and mad of a value over each key."""
    base = series.withColumn("_v", value.cast("double"))
    middle = base.groupBy(*keys).agg(F.median("_v").alias("median"))
    joined = base.join(middle, keys) if keys else base.crossJoin(F.broadcast(middle))
    spread = joined.groupBy(*keys).agg(F.median(F.abs(F.col("_v") - F.col("median"))).alias("mad"))
    return (joined.join(spread, keys) if keys else joined.crossJoin(F.broadcast(spread))).drop("_v")


def peaks(series: DataFrame, metric: str = "events", min_z: float = 3.0, min_value: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Days far above the whole series' median."""
    keys = keys or []
    found = with_spread(series, F.col(metric), keys).withColumn("z", X.robust_z(F.col(metric).cast("double"), F.col("median"), F.col("mad")))
    return found.where((F.col("z") >= min_z) & (F.col(metric) >= min_value) & (F.col(metric) > F.col("median"))).select(*keys, "date", F.col(metric).alias("value"), "median", "mad", "z")


def lulls(series: DataFrame, metric: str = "events", quiet: int = 0, min_run: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Runs of quiet days: gaps and islands by date less row number."""
    keys = keys or []
    still = series.where(F.col(metric) <= quiet)
    island = F.date_sub("date", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    runs = still.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"))
    return runs.where(F.col("days") >= min_run).drop("_island")


def weekday_profile(series: DataFrame, metric: str = "events") -> DataFrame:
    """Total, days and mean for Monday = 0 to Sunday; a weekday without days has zeros."""
    week = series.sparkSession.range(7).select(F.col("id").cast("int").alias("weekday"))
    got = series.groupBy(F.weekday("date").alias("weekday")).agg(F.sum(metric).alias("total"), F.count("*").alias("days"))
    out = week.join(got, "weekday", "left")
    total, days = F.coalesce("total", F.lit(0).cast("long")), F.coalesce("days", F.lit(0).cast("long"))
    return out.select("weekday", total.alias("total"), days.alias("days"), F.when(days > 0, total / days).otherwise(0.0).alias("mean"))


def line(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of least squares as aggregates, from exact integer sums; a slope of 0 where x doesn't vary."""
    n, sx, sy = F.count(y), F.sum(x), F.sum(y)
    sxx, sxy = F.sum(x * x), F.sum(x * y)
    slope = F.when(n * sxx - sx * sx != 0, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(0.0)
    return slope, (sy - slope * sx) / n


def tail(series: DataFrame, days: int, keys: list[str] | None = None) -> DataFrame:
    """The last days of each key, with x = 0, 1, ..."""
    keys = keys or []
    w = Window.partitionBy(*keys)
    back = F.row_number().over(w.orderBy(F.desc("date")))
    return series.withColumn("_back", back).where(F.col("_back") <= days).withColumn("_n", F.count("*").over(w)).withColumn("x", (F.col("_n") - F.col("_back")).cast("long")).drop("_back")


def forecast(series: DataFrame, metric: str = "events", horizon: int = 7, fit_days: int = 28, keys: list[str] | None = None) -> DataFrame:
    """A fitted line carried on, not below zero; direction by slope beyond 0.05 a day."""
    keys = keys or []
    slope, intercept = line(F.col("x"), F.col(metric))
    fit = tail(series, max(2, fit_days), keys).groupBy(*keys).agg(slope.alias("slope"), intercept.alias("intercept"), F.max("date").alias("last"), F.max("_n").alias("n"))
    step = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    value = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")))
    direction = F.when(F.col("slope") > 0.05, "rising").when(F.col("slope") < -0.05, "falling").otherwise("flat")
    return step.select(*keys, F.date_add("last", F.col("step")).alias("date"), value.alias("value"), "slope", direction.alias("direction"))


def tempo_board(ev: DataFrame, by: str = "country", window: int = 7, fit_days: int = 28, horizon: int = 7, min_days: int = 3, rise: float = 0.10) -> DataFrame:
    """For each key, from its own first day to the last day of all: recent and prior mean, momentum, the fitted line with
    its residual deviation, the projected total, and the trend. Blank keys have no part."""
    series = dense_daily(ev.where(F.coalesce(F.trim(by), F.lit("")) != ""), [by], last_shared=True)
    w = Window.partitionBy(by)
    back = series.withColumn("_back", F.row_number().over(w.orderBy(F.desc("date")))).withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= min_days)
    span = F.least(F.lit(max(2, fit_days)), F.col("_n"))
    inside = F.col("_back") <= span
    x = F.when(inside, (span - F.col("_back")).cast("long"))
    y = F.when(inside, F.col("events"))
    n, sx, sy, sxx, sxy, syy = F.count(y), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y), F.sum(y * y)
    got = back.groupBy(by).agg(
        F.max("date").alias("last"), F.max("_n").alias("days"), F.sum("events").alias("total"),
        F.sum(F.when(F.col("_back") <= window, F.col("events"))).alias("_r"), F.count_if(F.col("_back") <= window).alias("_rn"),
        F.sum(F.when(F.col("_back").between(window + 1, 2 * window), F.col("events"))).alias("_p"), F.count_if(F.col("_back").between(window + 1, 2 * window)).alias("_pn"),
        n.alias("_k"), sx.alias("_sx"), sy.alias("_sy"), (n * sxx - sx * sx).alias("_dxx"), (n * sxy - sx * sy).alias("_dxy"), (n * syy - sy * sy).alias("_dyy"),
    )
    slope = F.when(F.col("_dxx") != 0, F.col("_dxy") / F.col("_dxx")).otherwise(0.0)
    got = got.withColumn("slope", slope).withColumn("intercept", (F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("_k"))
    # Residual variance: (Syy - slope * Sxy) / n, of centred sums, each of them an integer over n.
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("_dyy") - F.col("slope") * F.col("_dxy")) / F.col("_k") / F.col("_k")))
    at = lambda s: F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("_k") - 1 + s))
    projected = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(horizon)), at), F.lit(0.0), lambda a, b: a + b)
    trend = F.when(F.col("slope") > rise, "rising").when(F.col("slope") < -rise, "falling").otherwise("steady")
    recent, prior = F.col("_r") / F.col("_rn"), F.when(F.col("_pn") > 0, F.col("_p") / F.col("_pn"))
    return got.select(by, "last", "days", "total", recent.alias("recent"), prior.alias("prior"), (recent - prior).alias("momentum"), "slope", sigma.alias("sigma"), projected.alias("projected"), trend.alias("trend"))


#: The lowest index of each level above the first.
_LEVELS = tuple(zip((80, 60, 40, 20), reversed(LEVELS[1:])))


def escalation_index(ev: DataFrame, window: int = 7, baseline_windows: int = 4, weights: tuple[float, float, float] = (0.40, 0.35, 0.25), rise: float = 5.0) -> DataFrame:
    """A rolling index from 0 to 100 of tempo, intensity and spread against the windows before.

    With daily rows numbered i, a point exists from i = 2 * window - 1 on. Footprints are the distinct places of the last
    ``window`` days, from one row for each day and place."""
    w, b = window, window * baseline_windows
    place = X.first_of("location", "region", "country")
    days = dense_daily(ev)
    # A place is in the footprint of a day if it was seen on it or up to w - 1 days before.
    seen = ev.where(F.col("date").isNotNull()).select("date", place.alias("place")).where("place IS NOT NULL").distinct()
    foot = seen.select("place", F.explode(F.sequence("date", F.date_add("date", w - 1))).alias("date")).distinct().groupBy("date").agg(F.count("*").alias("fp"))
    series = days.join(foot, "date", "left").withColumn("fp", F.coalesce("fp", F.lit(0).cast("long")))
    order = Window.orderBy("i")
    rows = lambda lo, hi: order.rowsBetween(lo, hi)
    series = series.withColumn("full_fp", F.when(F.col("i") >= w - 1, F.col("fp")))
    calc = series.select(
        "date", "i", F.sum("events").over(rows(1 - w, 0)).alias("recent"), F.sum("magnitude").over(rows(1 - w, 0)).alias("recent_mag"), F.col("fp").alias("spread"),
        F.sum("events").over(rows(1 - w - b, -w)).alias("base"), F.sum("magnitude").over(rows(1 - w - b, -w)).alias("base_mag"), F.sum("full_fp").over(rows(-b, -w)).alias("_fps"), F.count("full_fp").over(rows(-b, -w)).alias("_fpn"),
    ).where(F.col("i") >= 2 * w - 1)
    nb = F.least(F.lit(b), F.col("i") - w + 1)
    per = F.col("base") * float(w) / nb
    ratios = {
        "tempo": F.col("recent") / F.greatest(per, F.lit(1.0)),
        "intensity": F.when(F.col("recent_mag") == 0, 0.0).otherwise((F.col("recent_mag") / F.greatest(F.col("recent"), F.lit(1))) / F.greatest(F.coalesce(F.try_divide("base_mag", "base"), F.lit(0.0)), F.lit(0.5))),
        "spread": F.col("spread") / F.greatest(F.coalesce(F.try_divide("_fps", "_fpn"), F.lit(0.0)), F.lit(1.0)),
    }
    total = sum(max(0.0, x) for x in weights) or 1.0
    used = [max(0.0, x) / total for x in weights] if sum(max(0.0, x) for x in weights) else [0.40, 0.35, 0.25]
    damp = F.least(F.lit(1.0), F.col("recent") / 6.0)
    index = sum((X.saturate(r) * u for r, u in zip(ratios.values(), used, strict=True)), F.lit(0.0)) * damp
    out = calc.select("date", "i", "recent", "recent_mag", "spread", *[r.alias(f"{n}_ratio") for n, r in ratios.items()], index.alias("index"))
    level = F.lit(LEVELS[0])
    for bound, name in reversed(_LEVELS):
        level = F.when(F.col("index") >= bound, name).otherwise(level)
    delta = F.col("index") - F.lag("index", w).over(order)
    direction = F.when(delta >= rise, "rising").when(delta <= -rise, "falling").otherwise("steady")
    return out.select("date", "recent", "recent_mag", "spread", "tempo_ratio", "intensity_ratio", "spread_ratio", "index", level.alias("level"), delta.alias("delta"), direction.alias("direction"))


def escalation_summary(index: DataFrame) -> DataFrame:
    """The last point, the first highest, and how many points rise and fall."""
    return index.agg(F.max_by("index", "date").alias("current"), F.max_by("level", "date").alias("level"), F.max("index").alias("peak"), F.max_by("date", F.struct("index", -F.datediff("date", F.lit("1970-01-01")))).alias("peak_date"), F.count_if(F.col("direction") == "rising").alias("rising"), F.count_if(F.col("direction") == "falling").alias("falling"))


def escalation_now(index: DataFrame, window: int = 7, weights: tuple[float, float, float] = (0.40, 0.35, 0.25)) -> DataFrame:
    """The latest point: its index, level and direction, the slope a day over the last window, and the components by what
    they add to it, largest first."""
    last = tail(index.select("date", "index", "level", "direction", "tempo_ratio", "intensity_ratio", "spread_ratio"), window)
    slope, _ = line(F.col("x"), F.col("index"))
    got = last.agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in ("index", "level", "direction", "tempo_ratio", "intensity_ratio", "spread_ratio")], slope.alias("slope_per_day"))
    part = [F.struct((-F.round(X.saturate(F.col(f"{n}_ratio")) * w, 6)).alias("k"), F.lit(n).alias("name")) for n, w in zip(("tempo", "intensity", "spread"), weights, strict=True)]
    drivers = F.array_join(F.transform(F.array_sort(F.array(*part)), lambda d: d["name"]), ",")
    return got.select("date", "index", "level", "direction", "slope_per_day", drivers.alias("drivers"))


def tempo_summary(board: DataFrame, by: str = "country", top: int = 5) -> DataFrame:
    """One row: keys by trend, the projected total, and the fastest rising keys."""
    count = lambda t: F.count_if(F.col("trend") == t).alias(t)
    got = board.agg(F.count("*").alias("keys"), count("rising"), count("steady"), count("falling"), F.round(F.sum("projected"), 3).alias("projected_total"))
    fast = board.where("trend = 'rising'").orderBy(F.desc("slope"), F.desc("projected"), by).limit(top)  # a top-k, not a sort
    names = fast.agg(F.array_sort(F.collect_list(F.struct((-F.col("slope")).alias("s"), (-F.col("projected")).alias("p"), F.col(by).alias("n")))).alias("_top"))
    return got.crossJoin(F.broadcast(names)).select("keys", "rising", "steady", "falling", "projected_total", F.array_join(F.transform("_top", lambda r: r["n"]), ",").alias("top_rising"))
