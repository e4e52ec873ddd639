"""A training-corpus pipeline of five stages over ``documents``: quality rules, near duplicates, repeated passages, mixing
to source weights, and piece ids. Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of docs.

Stage results: documents that fail a quality rule go, and frequent lines leave the others; of each near-duplicate group
(fingerprints within op 3's two bits, or a Jaccard similarity of 0.8 or more on five-word shingles) the document with the
smallest id stays; bytes of repeated passages are cut from all but their first text; documents are repeated or dropped so
that sources meet their weights; texts become sampled piece ids, checked to decode to the text. Rows that repeat an id share
its decision in the second stage; the rules and the mix decide by row. Rows with a null id are judged by the rules and pass
the other stages unchanged, but for mixing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import mixing, near_copies, pieces, quality_rules, repeats, simhash
from fieldglass.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(docs).where(F.col("doc_id") != F.col("component_id"))
    edges = found.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).unionByName(near_copies.pairs(docs))
    joined = simhash.components(edges, Scratch(spark, "copies"))
    copies = joined.where(F.col("node") != F.col("component")).select(F.col("node").alias("_copy_id")).distinct()
    return docs.join(copies, docs["doc_id"].cast("long") == copies["_copy_id"], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cut(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_weights),
    ("sentencepiece encoding and decoding", piece_ids),
]
#: Hashed fingerprints, random rounding and sampled pieces aren't SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
