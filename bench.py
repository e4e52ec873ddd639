"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to compile its code, then RUNS times; its time is the median. Results are written to Spark's noop
sink, so every row and column is made."""

from __future__ import annotations

import json
import os
import statistics
import time

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
WHERE, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "hotspots timeline actor_activity summary dedupe moving_average peaks forecast tempo_board escalation_series alerts_ranked_stream_location posture_stream_location "
    "cooccurrence actor_edges degree flux_structure flux_trajectories clusters merge attrition_board bm25_topk keywords watchlist_screen recommend extract normalize tumbling_windows session_windows ride_report"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from fieldglass import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            registry.QUERIES[name](spark, WHERE).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "event queries, sum of medians of warm runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(WHERE.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "runs": RUNS}))


if __name__ == "__main__":
    main()
