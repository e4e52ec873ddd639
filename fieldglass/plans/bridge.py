"""Event views over the benchmark tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "seq date event_type actor1 actor2 country region location lat lon magnitude source notes".split()

_ORDERS_TYPE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'battle' WHEN '2' THEN 'drone/uas' WHEN '3' THEN 'riots' WHEN '4' THEN 'protests' ELSE 'other' END"
_STREAM_TYPE = "CASE event_type WHEN 'error' THEN 'explosion/remote' WHEN 'purchase' THEN 'battle' WHEN 'signup' THEN 'drone/uas' WHEN 'click' THEN 'protests' ELSE 'other' END"

#: Expressions that mean the same in Spark and DuckDB.
_ORDERS = {
    "seq": "o_orderkey", "date": "CAST(o_orderdate AS DATE)", "event_type": _ORDERS_TYPE, "actor1": "c_mktsegment", "actor2": "o_orderstatus", "country": "n_name", "region": "r_name",
    "location": "concat('L', CAST(o_custkey % 40 AS STRING))", "lat": "CAST((o_custkey % 90) - 45 AS DOUBLE)", "lon": "CAST(((o_custkey * 7) % 180) - 90 AS DOUBLE) + CAST(o_orderkey % 10 AS DOUBLE) / 100",
    "magnitude": "CAST(floor(o_totalprice / 50000) AS INT)", "source": "concat('S', CAST(o_orderkey % 3 AS STRING))", "notes": "o_orderpriority",
}
_STREAM = {
    "seq": "event_id", "date": "CAST(ts AS DATE)", "event_type": _STREAM_TYPE, "actor1": "concat('u', CAST(user_id % 60 AS STRING))", "actor2": "concat('u', CAST((user_id * 7 + event_id) % 60 AS STRING))",
    "country": "concat('C', CAST(user_id % 10 AS STRING))", "region": "concat('R', CAST(user_id % 3 AS STRING))", "location": "concat('L', CAST(user_id % 40 AS STRING))",
    "lat": "CAST((user_id % 90) - 45 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) / 10", "lon": "CAST(((user_id * 7) % 180) - 90 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) / 10",
    "magnitude": "CAST(floor(value / 50) AS INT)", "source": "concat('S', CAST(event_id % 3 AS STRING))", "notes": "props",
}


def ev_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long history: one event for each order, placed in its customer's nation."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(*[f"{x} AS {n}" for n, x in _ORDERS.items()])


def ev_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty dense days: one event for each row of the stream table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{x} AS {n}" for n, x in _STREAM.items()])


EV_ORDERS = "evo AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _ORDERS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
EV_STREAM = "evs AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _STREAM.items()) + " FROM events)"

#: Force readings: one for each order line; odd lines are produced, even ones lost, and some know the inventory.
_READINGS = {
    "seq": "l_orderkey * 10 + l_linenumber", "date": "CAST(l_shipdate AS DATE)", "category": "l_returnflag", "side": "l_linestatus",
    "produced": "CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "lost": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DOUBLE) * 2 ELSE CAST(0 AS DOUBLE) END",
    "inventory": "CASE WHEN l_orderkey % 97 = 0 THEN CAST(l_quantity AS DOUBLE) * 1000 END", "source": "'lines'",
}
#: A log: seconds from the first day, channels by type, and motion from the value.
_LOG = {
    "seq": "event_id", "vehicle": "concat('v', CAST(user_id % 20 AS STRING))", "channel": "event_type", "t": "CAST(event_id AS DOUBLE) / 2", "accel": "CAST(event_id % 17 AS DOUBLE) / 8 - 1", "lateral": "CAST(event_id % 11 AS DOUBLE) / 8",
    "tilt": "CAST(event_id % 13 AS DOUBLE)", "speed": "CAST(event_id % 7 AS DOUBLE)",
}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{x} AS {n}" for n, x in _READINGS.items()])


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{x} AS {n}" for n, x in _LOG.items()])


READINGS = "rd AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _READINGS.items()) + " FROM lineitem)"
LOG = "lg AS (SELECT " + ", ".join(f'{x} AS "{n}"' for n, x in _LOG.items()) + " FROM events)"
