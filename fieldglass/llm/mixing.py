"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents is to get on average, from 0
to 2. The whole part is taken outright. The fractional parts are rounded pairwise: two documents with fractional copy
probabilities exchange probability, words for words, at random and without changing either's expectation, until one of
them is integral; the other meets the next document. So a source's taken words miss its target by less than one
document. Documents are dealt by a hash of their id into groups of bounded size; a group leaves one fractional
residual, and the residuals meet in further levels of the same step (a reduction tree) until a source has one, which a
last draw settles. All draws are hashes of ids, the level and the seed, so reruns agree, whatever the partitioning.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, after all
others. Rows that repeat an id are planned as documents of their own. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table

WEIGHTS, SHARE, MOST_COPIES, SEED = (5.0, 2.0, 1.0), 1.5, 2, 17
#: Documents in a group of the first level, and residuals in a group of a later one.
GROUP = 2048
#: Sources are planned on the driver: some tens of bytes each.
MAX_SOURCES = 1_000_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the words of the whole text; and row and tie, null where docs has no _mix_row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = [len(t.split()) if t else 0 for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(3), b.column(4)], ["doc_id", "source", "size", "row", "tie"])

    text, keyed = F.col("text").cast("string"), "_mix_row" in docs.columns
    row, tie = (F.col("_mix_row"), F.xxhash64(text)) if keyed else (F.lit(None).cast("long"),) * 2
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"), row.alias("row"), tie.alias("tie")).mapInArrow(count, "doc_id long, source string, size long, row long, tie long")


def targets(size_by_source: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> list[float]:
    """Targets of sources given in order: shares by weight, held at MOST_COPIES times the size; the excess is shared
    again by weight among the others until none is above."""
    size = np.array([s for _, s in size_by_source], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(size))], float)
    target, free, left = np.zeros(len(size)), np.ones(len(size), bool), share * size.sum()
    while free.any():
        part = left * weight / weight[free].sum()
        over = free & (part > MOST_COPIES * size)
        if not over.any():
            target[free] = part[free]
            break
        target[over] = MOST_COPIES * size[over]
        left -= target[over].sum()
        free &= ~over
    return [float(t) for t in target]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round copy probabilities in turn with uniform draws u. Returns them, all integral but at most that of the row
    whose index is returned (-1: none). The sum of size * p doesn't change."""
    p, at, eps = p.copy(), -1, 1e-12
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        if at < 0:
            at = i
            continue
        a, b = size[at], size[i]
        up, down = min((1 - p[at]) * a, p[i] * b), min(p[at] * a, (1 - p[i]) * b)  # words that can move to, and from, the first
        move = up if u[i] * (up + down) < down else -down
        p[at] += move / a
        p[i] -= move / b
        first, second = eps < p[at] < 1 - eps, eps < p[i] < 1 - eps
        if not first:
            p[at] = round(p[at])
        if not second:
            p[i] = round(p[i])
        at = at if first else i if second else -1
    return p, at


def _level(level: int, seed: int):
    def step(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("n", "ascending"), ("tie", "ascending"), ("row", "ascending")])
        h = group.column("h").to_numpy().view(np.uint64)
        size, p = group.column("size").to_numpy().astype(float), group.column("p").to_numpy().astype(float)
        u = (_mix(_mix(h + np.uint64(level + 1)) + np.uint64(seed) + np.arange(len(h), dtype=np.uint64)) >> np.uint64(11)) / 2.0**53
        p, at = pivot(size, p, u)
        open_ = np.zeros(len(p), bool)
        if at >= 0:
            open_[at] = True
        return group.set_column(group.schema.get_field_index("p"), "p", pa.array(p)).append_column("open", pa.array(open_)).drop_columns(["g"])

    return step


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """doc_id, size, source_size, target and copies, one row for each row of docs; and row, if docs has a _mix_row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.keep(sizes(docs))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    rows = by_source.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal = targets([(r.source, r["size"]) for r in rows], weights, share)
    levels, most = 1, max([1, *(r.n for r in rows)])
    groups = [max(1, -(-r.n // group)) for r in rows]
    plan_rows = spark.createDataFrame([(i, r.source, r["size"], t, g) for i, (r, t, g) in enumerate(zip(rows, goal, groups, strict=True))], "source_no int, source string, source_size long, target double, groups long")
    # One row a source: Spark broadcasts it while it is small, and joins it otherwise.
    known = sized.join(plan_rows, sized["source"].eqNullSafe(plan_rows["source"])).drop("source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = known.withColumn("each", each).withColumn("whole", F.floor("each").cast("int"))
    known = known.withColumn("p", F.when(F.col("size") > 0, F.col("each") - F.col("whole")).otherwise(F.lit(0.0)))
    known = known.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))).withColumn("g", F.pmod(F.col("h"), F.col("groups"))).withColumn("n", F.lit(1).cast("long"))
    cols = ["doc_id", "size", "source_no", "source_size", "target", "whole", "p", "h", "n", "row", "tie"]
    schema = "doc_id long, size long, source_no int, source_size long, target double, whole int, p double, h long, n long, row long, tie long, open boolean"
    done, level, todo = [], 0, known.select(*cols, "g")
    count = max([1, *groups])
    while True:
        out = scratch.keep(todo.groupBy("source_no", "g").applyInArrow(_level(level, seed), schema))
        if count <= 1:
            last = F.when(F.col("open"), (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("h")), F.lit(1 << 30)) / (1 << 30) < F.col("p")).cast("double")).otherwise(F.col("p"))
            done.append(out.withColumn("p", last))
            break
        done.append(out.where(~F.col("open")))
        count, level = -(-count // group), level + 1
        todo = out.where("open").select(*cols).withColumn("g", F.pmod(F.xxhash64(F.lit(seed + 1 + level), F.col("h")), F.lit(count)))
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("int")).otherwise(F.lit(0))
    return rounded.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), *(["row"] if "_mix_row" in docs.columns else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows are numbered in a table of their own, so that rows without
    an id, or that share one, each take their own count."""
    rows = Scratch(docs.sparkSession, "rows").keep(docs.withColumn("_mix_row", F.monotonically_increasing_id()))
    chosen = plan(rows, **options).where("copies > 0").select(F.col("row").alias("_mix_id"), F.col("copies").alias("_mix_copies"))
    out = rows.join(chosen, rows["_mix_row"] == chosen["_mix_id"])
    return out.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[rows[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
