"""The registered queries of this subpackage: one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, mixing, pieces, quality_classifier, quality_rules, repeats, simhash, token_counts, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_simhash": simhash.query,
    "op4_suffix_array": repeats.query,
    "op5_sentencepiece": pieces.query,
    "op6_token_counts": token_counts.query,
    "op7_toxicity": toxicity.query,
    "op8_url_filter": url_filter.query,
    "op9_mixing": mixing.query,
    "op10_ann": ann.query,
}

ORACLE: dict[str, str] = {"op1_quality_rules": quality_rules.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL}
