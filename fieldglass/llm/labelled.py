"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int) -> DataFrame:
    """doc_id, text and y of at most ``rows`` labelled documents that aren't held out, of at most ``longest`` bytes each.

    The rows are those with the smallest hash of their id among labelled documents that have such a text, so the sample
    doesn't depend on the partitioning. Where a document has several labels the larger counts; of several texts of one id
    that with the smallest hash is taken. Only ids are broadcast, and there are at most ``rows``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_y_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= longest)
    chosen = known.join(texts.select("_id"), F.col("_y_id") == F.col("_id"), "left_semi").orderBy(F.xxhash64("_y_id"), "_y_id").limit(rows)
    joined = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_y_id"))
    first = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    return joined.groupBy(F.col("_y_id").alias("doc_id")).agg(first.alias("text"), F.max("y").alias("y"))
