"""Incremental batches over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.relational import keep_first


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key has no finished row yet."""
    return work.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def retry_set(work: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Rows of ``work`` whose key failed."""
    return work.join(failed.select(key).distinct(), key, "left_semi")


def compact(stream: DataFrame, key: str, preference: Sequence[Column]) -> DataFrame:
    """The preferred row of each key."""
    return keep_first(stream.where(F.col(key).isNotNull()), [key], preference)


def repaired(stream: DataFrame, cache: DataFrame, key: str, ok: str, value: str) -> DataFrame:
    """``stream`` with values of ``cache`` (one row per key) where a row is not ok."""
    c = cache.select(key, F.col(value).alias("_v"))
    out = stream.join(c, key, "left")
    return out.withColumn(value, F.when(F.coalesce(F.col(ok), F.lit(False)), F.col(value)).otherwise(F.coalesce("_v", value))).drop("_v")


def pruned(cache: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Rows of the cache whose key is still live."""
    return cache.join(live.select(key).distinct(), key, "left_semi")


def filled(df: DataFrame, column: str, new: Column) -> DataFrame:
    """Backfill: blank values get ``new``, others stay; a second run changes nothing."""
    return df.withColumn(column, F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), new))
