"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import appearance, consensus, mixing, name_mapping, packing, tokens, truncation


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "evidence_items").select(F.lit("evidence_items").alias("src"), "id", F.col("extracted_text").alias("text"))
    terms = table(spark, sf_dir, "terms").select(F.lit("terms").alias("src"), "id", F.col("name").alias("text"))
    return appearance.same_looking_pairs(items.unionByName(terms), "src", "id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "annotations")).where("n_labels > 1").select("case_id", "requested_use", "label_field", "label")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "annotations"))


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(table(spark, sf_dir, "annotations"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_mapping.map_names(table(spark, sf_dir, "name_queries"), table(spark, sf_dir, "ref_terms"), table(spark, sf_dir, "genes"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_sizes(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(tokens.with_sizes(table(spark, sf_dir, "documents"), ["doc_id"], "text"), table(spark, sf_dir, "pack_capacities"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "pack_capacities"))


def p9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached when the selection is to be as large as all documents together."""
    sizes = _sizes(spark, sf_dir)
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.shares(sizes, table(spark, sf_dir, "mix_targets"), total)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut in mid-word or mid-sentence: a text cut right behind a full stop is no case."""
    return truncation.judged(table(spark, sf_dir, "documents")).where("truncated and in_sentence").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_consensus, p2_reliability, p6_found, p7_found, p8_packed, p8_report, p9_selected, p9_shares, p9_shares_of_all, p10_found, p10_rates)}
ORACLES: dict[str, str] = {}
