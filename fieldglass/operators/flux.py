"""How an actor graph changes over windows of days. One table of ties and one of actors carry the window number; there
are no per-window objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .link import connected_components


def windows(ev: DataFrame, days: int = 7) -> DataFrame:
    """Events with w: the number of their window among windows that hold an event, counted from the earliest day."""
    dated = ev.where(F.col("date").isNotNull())
    first = dated.agg(F.min("date").alias("_lo"))
    placed = dated.crossJoin(F.broadcast(first)).withColumn("_k", F.floor(F.datediff("date", "_lo") / days).cast("int"))
    numbers = placed.select("_k", "_lo").distinct().withColumn("w", F.row_number().over(Window.orderBy("_k")) - 1)  # a row a window
    return placed.drop("_lo").join(F.broadcast(numbers.select("_k", "w", F.date_add("_lo", F.col("_k") * days).alias("start"))), "_k").drop("_k")


def ties(placed: DataFrame) -> DataFrame:
    """w, a, b, weight."""
    names = F.array_distinct(F.filter(F.array(F.trim(F.coalesce("actor1", F.lit(""))), F.trim(F.coalesce("actor2", F.lit("")))), lambda x: x != ""))
    pairs = placed.select("w", names.alias("_n")).where(F.size("_n") == 2)
    return pairs.groupBy("w", F.array_min("_n").alias("a"), F.array_max("_n").alias("b")).agg(F.count("*").alias("weight"))


def actors(placed: DataFrame) -> DataFrame:
    """w, actor, events."""
    names = F.array_distinct(F.filter(F.array(F.trim(F.coalesce("actor1", F.lit(""))), F.trim(F.coalesce("actor2", F.lit("")))), lambda x: x != ""))
    return placed.select("w", F.explode(names).alias("actor")).groupBy("w", "actor").agg(F.count("*").alias("events"))


def structure(placed: DataFrame) -> DataFrame:
    """w, start, events, order (actors), size (ties) and density of each window."""
    base = placed.groupBy("w", "start").agg(F.count("*").alias("events"))
    order = actors(placed).groupBy("w").agg(F.count("*").alias("order"))
    size = ties(placed).groupBy("w").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    n, m = zero("order"), zero("size")
    return base.join(order, "w", "left").join(size, "w", "left").select("w", "start", "events", n.alias("order"), m.alias("size"), F.when(n > 1, m / (n * (n - 1) / 2)).otherwise(0.0).alias("density"))


def component_counts(placed: DataFrame) -> DataFrame:
    """Components of each window: windows are kept apart by naming nodes after them."""
    named = lambda c: F.concat_ws(":", F.lpad(F.col("w").cast("string"), 8, "0"), c)
    found = connected_components(ties(placed).select(named("a").alias("a"), named("b").alias("b")))
    joined = actors(placed).groupBy("w").agg(F.count("*").alias("n"))
    tied = found.groupBy(F.split("node", ":")[0].cast("int").alias("w")).agg(F.count("*").alias("absorbed"))
    return joined.join(tied, "w", "left").select("w", (F.col("n") - F.coalesce("absorbed", F.lit(0))).alias("components"))


def slope(i: Column, y: Column) -> Column:
    """Least squares from sums; 0 for a single point."""
    n, sx, sy, sxx, sxy = F.count(y), F.sum(i), F.sum(y), F.sum(i * i), F.sum(i * y)
    return F.when(n * sxx - sx * sx != 0, (n * sxy - sx * sy) / (n * sxx - sx * sx)).otherwise(0.0)


def trajectories(placed: DataFrame) -> DataFrame:
    """For each actor, over all windows (absent: 0): degrees as an array, first, last and peak window, and the slope."""
    near = ties(placed)
    degree = near.select("w", F.col("a").alias("actor")).unionByName(near.select("w", F.col("b").alias("actor"))).groupBy("w", "actor").agg(F.count("*").alias("degree"))
    present = actors(placed).join(degree, ["w", "actor"], "left").select("w", "actor", "events", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    n = placed.agg((F.max("w") + 1).alias("_n"))
    got = present.groupBy("actor").agg(F.map_from_entries(F.collect_list(F.struct("w", "degree"))).alias("_d"), F.sum("events").alias("events"), F.min("w").alias("first"), F.max("w").alias("last"), F.max_by("w", F.struct("degree", "w")).alias("peak"), F.sum("degree").alias("_sy"), F.sum(F.col("w") * F.col("degree")).alias("_sxy"))
    got = got.crossJoin(F.broadcast(n))
    k = F.col("_n").cast("long")
    sx, sxx = k * (k - 1) / 2, k * (k - 1) * (2 * k - 1) / 6
    rise = F.when(k * sxx - sx * sx != 0, (k * F.col("_sxy") - sx * F.col("_sy")) / (k * sxx - sx * sx)).otherwise(0.0)
    series = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda w: F.coalesce(F.try_element_at("_d", w), F.lit(0).cast("long")))
    return got.select("actor", "events", "first", "last", "peak", series.alias("degrees"), rise.alias("slope"), (k - 1).cast("int").alias("last_window"))


def rising(paths: DataFrame, top: int = 10) -> DataFrame:
    return paths.where("slope > 0").orderBy(F.desc("slope"), "actor").limit(top)


def fading(paths: DataFrame, top: int = 10) -> DataFrame:
    return paths.where("slope < 0").orderBy("slope", "actor").limit(top)


def emerging(paths: DataFrame, within: int = 1) -> DataFrame:
    """First seen in the last windows, though not in the first of all."""
    return paths.where((F.col("first") > F.col("last_window") - within) & (F.col("first") > 0))


def departed(paths: DataFrame, within: int = 1) -> DataFrame:
    return paths.where(F.col("last") <= F.col("last_window") - within)


def tie_changes(placed: DataFrame) -> DataFrame:
    """Ties formed, dissolved and kept from each window to the next."""
    near = ties(placed).select("w", "a", "b")
    old, new = near.withColumn("to", F.col("w") + 1).select("to", "a", "b").withColumn("_o", F.lit(1)), near.withColumnRenamed("w", "to").withColumn("_n", F.lit(1))
    last = placed.agg(F.max("w").alias("_last"))
    both = old.join(new, ["to", "a", "b"], "full").crossJoin(F.broadcast(last)).where("`to` BETWEEN 1 AND _last")
    return both.groupBy("to").agg(F.count_if(F.col("_o").isNull()).alias("formed"), F.count_if(F.col("_n").isNull()).alias("dissolved"), F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("kept"))


def persistent_ties(placed: DataFrame) -> DataFrame:
    """Ties of every window."""
    n = placed.agg((F.max("w") + 1).alias("_n"))
    return ties(placed).groupBy("a", "b").agg(F.count("*").alias("windows"), F.sum("weight").alias("weight")).crossJoin(F.broadcast(n)).where("windows = _n").drop("_n")


def emerging_ties(placed: DataFrame) -> DataFrame:
    """Ties of the last window that no earlier one has."""
    last = placed.agg(F.max("w").alias("_last"))
    got = ties(placed).groupBy("a", "b").agg(F.min("w").alias("first"), F.sum("weight").alias("weight"))
    return got.crossJoin(F.broadcast(last)).where("first = _last AND _last > 0").select("a", "b", "weight")


def structural_trend(shape: DataFrame, move: float = 0.05) -> DataFrame:
    """Density of the last window less that of the first."""
    rounded = shape.withColumn("density", F.round("density", 6))
    got = rounded.agg(F.count("*").alias("windows"), F.min_by("density", "w").alias("first"), F.max_by("density", "w").alias("last"))
    change = F.col("last") - F.col("first")
    return got.select("windows", "first", "last", change.alias("change"), F.when(change > move, "consolidating").when(change < -move, "fragmenting").otherwise("stable").alias("trend"))
