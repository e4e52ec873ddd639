"""Counts, sums and roll-ups over events. Ties are broken by name, so every ranking is a total order."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def _counts() -> list:
    return [F.count("*").alias("events"), F.sum("magnitude").cast("long").alias("magnitude")]


def dedupe(ev: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each key, by arrival order (seq)."""
    first = Window.partitionBy(key).orderBy("seq")
    return ev.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def within(ev: DataFrame, country: str | None = None, region: str | None = None, as_of: date | None = None) -> DataFrame:
    """Events of exactly a country and a region, up to a day; plain comparisons, so they reach the scan."""
    for column, value in (("country", country), ("region", region)):
        if value is not None:
            ev = ev.where(F.col(column) == value)
    return ev if as_of is None else ev.where(F.col("date") <= F.lit(as_of))


def hotspots(ev: DataFrame, n: int = 10) -> DataFrame:
    """Places by magnitude, then events."""
    place = X.first_of("region", "location", default="")
    found = ev.groupBy("country", place.alias("place")).agg(*_counts())
    return found.orderBy(F.desc("magnitude"), F.desc("events"), "country", "place").limit(n)


def timeline(ev: DataFrame) -> DataFrame:
    """Counts for each raw date; undated rows have no part."""
    return ev.where(F.col("date").isNotNull()).groupBy("date").agg(*_counts())


def actor_activity(ev: DataFrame, n: int = 10) -> DataFrame:
    """Events and magnitude of each actor; one in both slots counts twice."""
    both = ev.select(F.explode(F.array("actor1", "actor2")).alias("actor"), "magnitude").where(F.coalesce("actor", F.lit("")) != "")
    return both.groupBy("actor").agg(*_counts()).orderBy(F.desc("events"), "actor").limit(n)


def by_type(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(F.count("*").alias("events"))


def severity_mix(ev: DataFrame) -> DataFrame:
    return ev.groupBy(X.severity().alias("severity")).agg(F.count("*").alias("events"))


def trend(ev: DataFrame, window: int = 7) -> DataFrame:
    """The last window against the one before: counts, percent change (100 from nothing), escalating."""
    last = ev.agg(F.max("date").alias("last"))
    ago = F.datediff("last", "date")
    got = ev.select("date").crossJoin(F.broadcast(last)).agg(F.max("last").alias("last"), F.count_if(ago < window).alias("recent"), F.count_if((ago >= window) & (ago < 2 * window)).alias("prior"))
    pct = F.when(F.col("prior") > 0, 100.0 * (F.col("recent") - F.col("prior")) / F.col("prior")).when(F.col("recent") > 0, 100.0).otherwise(0.0)
    return got.select("last", "recent", "prior", pct.alias("pct_change"), (F.col("recent") > F.col("prior")).alias("escalating"))


def summary(ev: DataFrame, window: int = 7) -> DataFrame:
    """One row: totals, date range, countries, types, actors, and the trend."""
    total = ev.agg(F.count("*").alias("events"), F.sum("magnitude").cast("long").alias("magnitude"), F.min("date").alias("first"), F.countDistinct("country").alias("countries"), F.countDistinct("event_type").alias("types"), F.countDistinct("actor1").alias("actors"))
    return total.crossJoin(trend(ev, window))


def grouping_cube(ev: DataFrame) -> DataFrame:
    """Counts for all combinations of region and type, with totals."""
    return ev.cube("region", "event_type").agg(*_counts(), F.grouping_id().cast("long").alias("level"))


def coordinated_days(ev: DataFrame, least: int = 3) -> DataFrame:
    """Days on which at least so many distinct places had events."""
    place = X.first_of("region", "country")
    days = ev.where(F.col("date").isNotNull()).groupBy("date").agg(F.countDistinct(place).alias("places"), *_counts(), F.array_join(F.sort_array(F.collect_set(place)), ",").alias("place_list"))
    return days.where(F.col("places") >= least)


def _actors(ev: DataFrame) -> DataFrame:
    """Distinct trimmed actors of each event."""
    names = F.array_distinct(F.filter(F.array(F.trim(F.coalesce("actor1", F.lit(""))), F.trim(F.coalesce("actor2", F.lit("")))), lambda x: x != ""))
    return ev.select("seq", "date", "magnitude", names.alias("actors"))


def actor_nodes(ev: DataFrame) -> DataFrame:
    return _actors(ev).select(F.explode("actors").alias("actor"), "magnitude").groupBy("actor").agg(*_counts())


def actor_edges(ev: DataFrame, least: int = 1) -> DataFrame:
    """Undirected ties a < b between the two actors of an event, with weight and magnitude."""
    pairs = _actors(ev).where(F.size("actors") == 2).select(F.array_min("actors").alias("a"), F.array_max("actors").alias("b"), "magnitude")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), F.sum("magnitude").cast("long").alias("magnitude")).where(F.col("weight") >= least)


def cooccurrence(ev: DataFrame, window: int = 3, least: int = 2) -> DataFrame:
    """Pairs of different types at one place within ``window`` days, counted for each pair of events.

    The interval join is a join of day counts: for each place, day and type there is one row, so its size is that of the
    aggregate, not of the events, and a hot place costs days * types rows."""
    place = X.first_of("location", "region", "country")
    daily = ev.where(F.col("date").isNotNull()).groupBy(place.alias("place"), "date", "event_type").agg(F.count("*").alias("n")).where("place IS NOT NULL")
    later = daily.select("place", F.col("date").alias("date2"), F.col("event_type").alias("type2"), F.col("n").alias("n2"))
    ahead = daily.withColumn("date2", F.explode(F.sequence("date", F.date_add("date", window))))
    pairs = ahead.join(later, ["place", "date2"]).where((F.col("event_type") != F.col("type2")) & ((F.col("date") < F.col("date2")) | (F.col("event_type") < F.col("type2"))))
    counted = pairs.groupBy(F.least("event_type", "type2").alias("type_a"), F.greatest("event_type", "type2").alias("type_b")).agg(F.sum(F.col("n") * F.col("n2")).cast("long").alias("pairs"), F.countDistinct("place").alias("places"))
    return counted.where(F.col("pairs") >= least)


def scopes(ev: DataFrame) -> DataFrame:
    return ev.select("country", "region").distinct()


def catalog_stats(docs: DataFrame, column: str) -> DataFrame:
    """Documents for each value of a column."""
    return docs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
