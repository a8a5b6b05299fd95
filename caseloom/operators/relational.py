"""Joins, merges and first-or-last rules as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; give a total order to make it definite."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def left_counts(left: DataFrame, right: DataFrame, key: str, name: str, amount: Column | None = None) -> DataFrame:
    """``left`` with how much of ``right`` has its key, 0 if nothing; ``right`` is summed before the join."""
    n = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(amount if amount is not None else F.lit(1)).cast("bigint").alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def difference_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in one side only, with the side."""
    x, y = a.select(key).where(F.col(key).isNotNull()).distinct(), b.select(key).where(F.col(key).isNotNull()).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def range_join_first(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, order: Sequence[str], width: int) -> DataFrame:
    """Each point with the first range of its key that holds it.

    Both sides are dealt into buckets of ``width`` along the axis and joined on
    key and bucket, so no key is compared as a whole; a range stands in every
    bucket it touches. Points in no range are left out.
    """
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    hit = p.join(r, [key, "_b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_b")
    return keep_first(hit, [*points.columns], [F.col(c) for c in order])


def prefer_non_empty(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``left`` columns where they say something, else those of ``right`` (one row per key)."""
    r = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    pick = [F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"_{c}")).alias(c) for c in columns]
    return left.join(r, key, "left").select(key, *pick)


def merge_sources(sources: Sequence[tuple[str, DataFrame]], key: str, order: Sequence[str]) -> DataFrame:
    """The union of sources; of one key the row of the earliest source, then by ``order``."""
    parts = [df.withColumn("source_rank", F.lit(i)).withColumn("from_source", F.lit(name)) for i, (name, df) in enumerate(sources)]
    return keep_first(reduce(DataFrame.unionByName, parts), [key], [F.col("source_rank"), *[F.col(c) for c in order]])


def count_keys_strict(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing at run time if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    message = F.concat(F.lit("duplicate key "), F.col(key).cast("string"))
    return df.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(1))).where("_ok = 1").drop("_n", "_ok")


def interval_merge(df: DataFrame, key: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """Touching ranges of a key joined into one (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(start) > F.coalesce(F.max(end).over(w), F.col(start) - gap - 2) + gap + 1, 1).otherwise(0)
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order))
    return islands.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")
