"""Registered queries on windows over event time: in batch with SQL, and as streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.link import Tables
from ..streaming import streams as S

Q, O = {}, {}

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _batch(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").withColumn("value", F.round(F.col("value") * 100).cast("long"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    return s.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("value", F.round(F.col("value") * 100).cast("long"))


def run(df: DataFrame, mode: str) -> DataFrame:
    """All there is of a stream, as a table: each batch is written by its number, so a batch that runs again replaces
    itself; in complete mode the last batch is the result."""
    tables = Tables(df.sparkSession)
    where, last = f"{tables.path}/out", []

    def write(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{where}/batch={number}")
        last.append(number)

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{tables.path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    read = df.sparkSession.read.schema(df.schema)
    return read.parquet(f"{where}/batch={last[-1]}") if mode == "complete" else read.parquet(where).select(*df.columns)


def _add(name, query, sql, mode="complete"):
    Q[name], O[name] = (lambda s, d: query(_batch(s, d))), sql
    Q[f"{name}_streamed"], O[f"{name}_streamed"] = (lambda s, d: run(query(_stream(s, d)), mode)), sql


_V = "(SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
_add("tumbling_windows", lambda e: S.windowed(e, "7 days", keys=("event_type",)), f"SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS \"end\", event_type, count(*) AS events, CAST(sum(cents) AS BIGINT) AS total FROM {_V} GROUP BY 1, 2, 3")
_add("sliding_windows", lambda e: S.windowed(e, "7 days", "1 day"), f"SELECT day - CAST(k AS INT) * INTERVAL 1 DAY AS start, day + (7 - CAST(k AS INT)) * INTERVAL 1 DAY AS \"end\", count(*) AS events, CAST(sum(cents) AS BIGINT) AS total FROM (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, cents FROM {_V}), range(7) r(k) GROUP BY 1, 2")
_add("session_windows", lambda e: S.sessions(e, "6 hours", ("user_id",)), "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS events FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, n")

# Every row twice; the stream keeps one of each.
_twice = lambda e: e.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
Q["dedupe_streamed"] = lambda s, d: run(S.dedupe_stream(_twice(_stream(s, d)), "event_id").select("event_id", "user_id", "event_type"), "append")
O["dedupe_streamed"] = "SELECT event_id, user_id, event_type FROM events"

_kind = lambda: F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")).otherwise("other")
_incidents = lambda e: S.incident_store(e.select(
    F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("country"), F.col("event_id").alias("seq"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), _kind().alias("event_type"),
    F.concat(F.lit("L"), (F.col("user_id") % 40).cast("string")).alias("place"), X.tokens(F.col("props")).alias("words"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("value").alias("magnitude"), F.lit("s").alias("source"),
))
Q["incidents_streamed"] = lambda s, d: run(_incidents(_stream(s, d)), "append")
_acting = lambda e: S.entity_stream(e.select(F.col("ts").cast("date").alias("date"), F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("country"), "event_type", F.concat(F.lit("the Unit "), (F.col("user_id") % 60).cast("string")).alias("actor1"), F.when(F.col("event_type") == "error", "IDF").otherwise("").alias("actor2")))
Q["entities_streamed"] = lambda s, d: run(_acting(_stream(s, d)), "complete")
O["entities_streamed"] = "SELECT entity, count(*) AS mentions, min(date) AS first_seen, max(date) AS last_seen, CAST(count(DISTINCT event_type) AS INT) AS types, CAST(count(DISTINCT country) AS INT) AS countries FROM (SELECT 'Unit ' || user_id % 60 AS entity, CAST(ts AS DATE) AS date, event_type, user_id % 10 AS country FROM events UNION ALL SELECT 'Israel Defense Forces', CAST(ts AS DATE), event_type, user_id % 10 FROM events WHERE event_type = 'error') GROUP BY 1"
