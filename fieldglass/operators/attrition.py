"""Production, loss and inventory by category and side: trajectories, ratios, projections, boards and balances."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .link import Tables

KEYS = ["category", "side"]


def collapse(readings: DataFrame, as_of: date | None = None) -> DataFrame:
    """One row for each category, side and day: sums, and the day's last known inventory by arrival (seq)."""
    rows = readings.where(F.col("date").isNotNull())
    if as_of is not None:
        rows = rows.where(F.col("date") <= F.lit(as_of))
    known = F.when(F.col("inventory").isNotNull(), F.col("seq"))
    return rows.groupBy(*KEYS, "date").agg(F.sum(F.coalesce("produced", F.lit(0.0))).alias("produced"), F.sum(F.coalesce("lost", F.lit(0.0))).alias("lost"), F.max_by("inventory", known).alias("inventory"))


def scopes(readings: DataFrame) -> DataFrame:
    return readings.select(*KEYS).distinct()


def trajectory(readings: DataFrame, as_of: date | None = None) -> DataFrame:
    """Running stock: net change from the first reported inventory (0 without one), not below zero in what is shown."""
    days = collapse(readings, as_of).withColumn("net", F.col("produced") - F.col("lost"))
    w = Window.partitionBy(*KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEYS)
    run = days.withColumn("_run", F.sum("net").over(w)).withColumn("_at", F.min(F.when(F.col("inventory").isNotNull(), F.col("date"))).over(whole))
    run = run.withColumn("_anchor", F.max(F.when(F.col("date") == F.col("_at"), F.col("inventory"))).over(whole)).withColumn("_then", F.max(F.when(F.col("date") == F.col("_at"), F.col("_run"))).over(whole))
    stock = F.when(F.col("_at").isNull(), F.col("_run")).otherwise(F.col("_anchor") + F.col("_run") - F.col("_then"))
    return run.select(*KEYS, "date", "produced", "lost", "net", F.greatest(F.lit(0.0), F.round(stock, 2)).alias("stock"))


def attrition_ratio(readings: DataFrame, window: int = 30, as_of: date | None = None) -> DataFrame:
    """Lost over produced in the last rows of each scope; null where nothing was produced, then not sustainable."""
    back = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("date")))
    got = collapse(readings, as_of).withColumn("_back", back).where(F.col("_back") <= window).groupBy(*KEYS).agg(F.sum("produced").alias("produced"), F.sum("lost").alias("lost"))
    ratio = F.try_divide("lost", "produced")
    return got.select(*KEYS, "produced", "lost", ratio.alias("ratio"), F.coalesce(ratio <= 1, F.lit(False)).alias("sustainable"))


def project(readings: DataFrame, fit_days: int = 180, as_of: date | None = None) -> DataFrame:
    """A line through the last days of stock (the last two points where the span holds one): the current stock, the daily
    slope, the residual deviation, and the day of depletion at current / -slope."""
    path = trajectory(readings, as_of)
    w = Window.partitionBy(*KEYS)
    path = path.withColumn("_last", F.max("date").over(w)).withColumn("_first", F.min("date").over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.desc("date"))))
    path = path.withColumn("_in", F.datediff("_last", "date") <= fit_days).withColumn("_k", F.count_if("_in").over(w))
    used = path.where(F.when(F.col("_k") >= 2, F.col("_in")).otherwise(F.col("_back") <= 2))
    x, y = F.datediff("date", "_first").cast("double"), F.col("stock")
    n, sx, sy, sxx, sxy, syy = F.count("*"), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y), F.sum(y * y)
    got = used.groupBy(*KEYS).agg(F.max("date").alias("last"), F.max_by("stock", "date").alias("current"), n.alias("points"), (n * sxx - sx * sx).alias("_xx"), (n * sxy - sx * sy).alias("_xy"), (n * syy - sy * sy).alias("_yy"))
    slope = F.when(F.col("_xx") != 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    got = got.withColumn("slope", slope)
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("_yy") - F.col("slope") * F.col("_xy")) / F.col("points") / F.col("points")))
    days = F.when((F.col("slope") < 0) & (F.col("current") > 0), F.col("current") / -F.col("slope"))
    return got.select(*KEYS, "last", "current", "points", "slope", sigma.alias("sigma"), days.alias("days_left"), F.when(days < 1e6, F.date_add("last", F.round(days).cast("int"))).alias("depletion"))


def projected_days(projection: DataFrame, horizon: int = 30) -> DataFrame:
    """Daily stock ahead with a band of one deviation, not below zero."""
    step = projection.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    at = F.col("current") + F.col("slope") * F.col("step")
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return step.select(*KEYS, F.date_add("last", F.col("step")).alias("date"), floor(at).alias("stock"), floor(at - F.col("sigma")).alias("low"), floor(at + F.col("sigma")).alias("high"))


def board(projection: DataFrame) -> DataFrame:
    """Scopes by how soon they run out; those that don't, last."""
    return Tables(projection.sparkSession).ranked(projection, F.col("days_left").asc_nulls_last(), "category", "side")


def balance(readings: DataFrame, left: str, right: str, as_of: date | None = None) -> DataFrame:
    """Current stock of two sides of each category and their ratio."""
    now = trajectory(readings, as_of).groupBy(*KEYS).agg(F.max_by("stock", "date").alias("stock"))
    a, b = (now.where(F.col("side") == s).select("category", F.col("stock").alias(n)) for s, n in ((left, "left_stock"), (right, "right_stock")))
    both = a.join(b, "category", "full")
    return both.withColumn("ratio", F.try_divide("left_stock", "right_stock"))


def summary(readings: DataFrame) -> DataFrame:
    return collapse(readings).groupBy("category").agg(F.countDistinct("side").alias("sides"), F.count("*").alias("days"), F.sum("produced").alias("produced"), F.sum("lost").alias("lost"))
