"""Registered queries of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import mixing, mojibake, packing, pairs, scans, tokens
from caseloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_broken_pairs(table(spark, sf_dir, "answer_records")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs by model and defect, beside all pairs of the model."""
    records = table(spark, sf_dir, "answer_records")
    found = pairs.find_broken_pairs(records).distinct()
    models = records.select("answer_id", F.coalesce(F.regexp_replace(F.lower(F.trim("model_name")), r"[\s_]+", "-"), F.lit("")).alias("model")).distinct()
    total = models.groupBy("model").agg(F.count_distinct("answer_id").alias("answers"))
    return models.join(found, "answer_id").groupBy("model", "defect").agg(F.count_distinct("answer_id").alias("defective")).join(total, "model")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_traces(table(spark, sf_dir, "page_hits"))[1].select("doc_id", "page_index", "noise", "value").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with an excerpt as continuous paragraphs."""
    return scans.repair_pages(table(spark, sf_dir, "page_hits"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_sizes(table(spark, sf_dir, "documents")))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p6_packed(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tokens.token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tokens.token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair_encoding(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "recoverable").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their text as far as it can be had."""
    return mojibake.repair_encoding(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_repaired, p6_packed, p6_report, p7_mix, p7_report, p8_found, p8_restored)}

SQL: dict[str, str] = {}
