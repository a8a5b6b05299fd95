"""Deterministic splits and samples, ordered by hashes and never by chance alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*parts: Column, seed: int = 42) -> Column:
    """MD5 of seed and parts: an order any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def stratified_split(df: DataFrame, key: str, stratum: str, ratio: float, seed: int = 42) -> DataFrame:
    """``test`` for the first ``ratio`` of each stratum in hash order, else ``train``.

    Shares are taken from hash values and not from positions, so no stratum is
    sorted in one task; a stratum of fewer than two keys stays in train.
    """
    n = df.groupBy(stratum).agg(F.count_distinct(key).alias("_n"))
    u = F.conv(F.substring(hash_order(F.col(key), seed=seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return df.join(n, stratum).withColumn("split", F.when((u < ratio) & (F.col("_n") > 1), "test").otherwise("train")).drop("_n")


def quota_sample(df: DataFrame, key: str, stratum: str, quota: int, seed: int = 42) -> DataFrame:
    """At most ``quota`` rows of each stratum, the first in hash order."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed=seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota).drop("_r")


def proportional_sample(df: DataFrame, key: str, stratum: str, size: int, seed: int = 42) -> DataFrame:
    """About ``size`` rows, each stratum by its share and with one row at least."""
    share = df.groupBy(stratum).agg(F.count("*").alias("_n")).withColumn("_take", F.greatest(F.lit(1), F.round(F.col("_n") * F.lit(float(size)) / F.sum("_n").over(Window.partitionBy()))))
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed=seed), key)
    return df.join(share, stratum).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_take")).drop("_n", "_take", "_r")


def leak_repair(df: DataFrame, group: str, split: str) -> DataFrame:
    """``df`` with whole groups moved to train where any of their rows is in train."""
    train = df.where((F.col(split) == "train") & F.col(group).isNotNull()).select(group).distinct().withColumn("_t", F.lit(True))
    return df.join(train, group, "left").withColumn(split, F.when(F.col("_t"), F.lit("train")).otherwise(F.col(split))).drop("_t")


def signature(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, signature)``: the sorted distinct values of a key as one text."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("signature"))


def stratified_folds(rows: DataFrame, key: str, stratum: str, folds: int, least: int, salt: str = "f") -> DataFrame:
    """``(key, stratum, fold)``: every stratum is shared out evenly over the folds.

    Strata of fewer than ``least`` rows become one, ``merged``. A stratum is
    dealt in hash order within sixteen parts, each beginning at the fold that
    its hash names, so that a large one is never sorted in one task and the
    folds of a stratum differ by at most one row per part.
    """
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    m = rows.join(counts, stratum).select(key, F.when(F.col("_n") < least, "merged").otherwise(F.col(stratum)).alias("stratum"))
    h = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    part = Window.partitionBy("stratum", F.substring(h, 1, 1)).orderBy(h, key)
    return m.select(key, "stratum", ((F.row_number().over(part) - 1 + F.ascii(h)) % folds).cast("int").alias("fold"))
