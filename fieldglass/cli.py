"""Command line: python -m fieldglass.cli COMMAND FILE ... Results are JSON lines, or text for reports.

Input is any format that ``read_events`` knows, or Parquet of event columns. Output of a query is printed as it is
collected, so queries that give more rows than --limit need --out, which executors write."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregates as A
from .operators import attrition as T
from .operators import detect as D
from .operators import flux as W
from .operators import graph as G
from .operators import link as L
from .operators import series as S
from .operators import text as X
from .sources import readers, sinks

Options = argparse.Namespace


def _graph(measure: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, Options], DataFrame]:
    return lambda ev, o: measure(A.actor_nodes(ev), A.actor_edges(ev))


#: Commands on events.
COMMANDS: dict[str, Callable[[DataFrame, Options], DataFrame]] = {
    "ingest": lambda ev, o: A.dedupe(ev),
    "analyze": lambda ev, o: A.summary(ev, o.window),
    "hotspots": lambda ev, o: A.hotspots(ev, o.top),
    "timeline": lambda ev, o: A.timeline(ev),
    "actors": lambda ev, o: A.actor_activity(ev, o.top),
    "watch": lambda ev, o: D.ranked(D.detect(ev, o.scope, o.window, o.baseline, o.as_of, o.min_severity)),
    "posture": lambda ev, o: D.posture(ev, o.scope, o.window, o.baseline, o.as_of),
    "trends": lambda ev, o: S.peaks(S.dense_daily(ev)),
    "lulls": lambda ev, o: S.lulls(S.dense_daily(ev)),
    "forecast": lambda ev, o: S.forecast(S.dense_daily(ev)),
    "escalation": lambda ev, o: S.escalation_index(A.within(ev, as_of=o.as_of), o.window, o.baseline),
    "tempo": lambda ev, o: S.tempo_board(A.within(ev, as_of=o.as_of), o.scope if o.scope in ("country", "region", "location") else "country", o.window),
    "correlate": lambda ev, o: L.clusters(ev, o.radius, o.gap, o.least),
    "cooccurrence": lambda ev, o: A.cooccurrence(ev, o.gap),
    "coordinated": lambda ev, o: A.coordinated_days(ev, o.least),
    "merge": lambda ev, o: L.merge(ev, max_day_gap=o.gap, radius_km=o.radius),
    "network": lambda ev, o: A.actor_edges(ev),
    "ranking": lambda ev, o: G.ranking(A.actor_nodes(ev), A.actor_edges(ev), o.metric, o.top),
    "communities": _graph(G.communities),
    "flux": lambda ev, o: W.structure(W.windows(ev, o.window)),
    "entities": lambda ev, o: X.entity_registry(ev),
    "sanctions": lambda ev, o: X.screen(ev, readers.sdn(ev.sparkSession, o.list)),
    "adapt": lambda ev, o: sinks.to_jsonl(ev),
}
#: Commands on other tables.
TABLES: dict[str, Callable[[SparkSession, Options], DataFrame]] = {
    "kbsearch": lambda s, o: X.bm25(_table(s, o).withColumnRenamed(o.id, "doc_id"), o.query, k=o.top),
    "extract": lambda s, o: X.extract(s.read.text(o.file).withColumnRenamed("value", "text")),
    "attrition": lambda s, o: T.board(T.project(readers.readings(_table(s, o)))),
    "feed": lambda s, o: readers.feed_items(s, o.file),
}


def _table(spark: SparkSession, o: Options) -> DataFrame:
    return spark.read.parquet(o.file) if o.format == "parquet" else spark.read.option("header", True).csv(o.file) if o.format == "csv" else spark.read.option("multiLine", True).json(o.file)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldglass", description=__doc__)
    p.add_argument("command", choices=[*COMMANDS, *TABLES, "report", "export"])
    p.add_argument("file")
    p.add_argument("--format", default="auto", help="auto, parquet, or a reader's name")
    p.add_argument("--out", help="write here instead of printing")
    p.add_argument("--limit", type=int, default=1000, help="most rows to print")
    for name, kind, default in (("window", int, 7), ("baseline", int, 4), ("top", int, 10), ("gap", int, 3), ("least", int, 3), ("radius", float, 50.0)):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name, default in (("scope", "country"), ("as-of", None), ("min-severity", "info"), ("metric", "degree"), ("list", None), ("query", ""), ("id", "doc_id"), ("to", "markdown"), ("country", None), ("region", None)):
        p.add_argument(f"--{name}", default=default)
    return p


def _events(spark: SparkSession, o: Options) -> DataFrame:
    ev = spark.read.parquet(o.file) if o.format == "parquet" else readers.read_events(spark, o.file, o.format)
    return A.within(ev, o.country, o.region)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    if o.as_of is not None:
        import datetime

        o.as_of = datetime.date.fromisoformat(o.as_of)
    spark = spark or SparkSession.builder.appName("fieldglass").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if o.command in ("report", "export"):
            made = sinks.export(_events(spark, o), o.to)
        elif o.command in TABLES:
            made = TABLES[o.command](spark, o)
        else:
            made = COMMANDS[o.command](_events(spark, o), o)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if isinstance(made, str):
        if o.out:
            with open(o.out, "w", encoding="utf-8") as f:
                f.write(made)
        else:
            print(made)
        return 0
    if o.out:
        made.write.mode("overwrite").json(o.out) if made.columns != ["value"] else made.write.mode("overwrite").text(o.out)
        return 0
    rows = made.limit(o.limit + 1).collect()
    for r in rows[: o.limit]:
        print(r["value"] if made.columns == ["value"] else json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))
    if len(rows) > o.limit:
        print(f"over {o.limit} rows: the rest isn't printed; use --out", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
