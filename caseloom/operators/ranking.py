"""Ranked lists: fusion, merging, normalising, selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import written


def by_score(query: str = "qid", score: str = "score", item: str = "doc_id") -> Window:
    """The total order of every list: score down, then item."""
    return Window.partitionBy(query).orderBy(F.desc(score), F.col(item))


def ranked(df: DataFrame, k: int | None = None, query: str = "qid", score: str = "score", item: str = "doc_id") -> DataFrame:
    """Ranks from 1; the first ``k`` of each list are kept."""
    out = df.withColumn("rank", F.row_number().over(by_score(query, score, item)))
    return out if k is None else out.where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: Sequence[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """``(qid, doc_id, score)``: the sum of weight / (k + rank) over ranked lists."""
    parts = [df.select("qid", "doc_id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionAll, parts).groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def max_merge(lists: Sequence[tuple[str, DataFrame, float]]) -> DataFrame:
    """``(qid, doc_id, score, via)``: the best weighted score of each item and its lane."""
    parts = [df.select("qid", "doc_id", (F.col("score") * float(w)).alias("score"), F.lit(name).alias("via")) for name, df, w in lists]
    best = reduce(DataFrame.unionAll, parts).groupBy("qid", "doc_id").agg(F.max(F.struct("score", "via")).alias("x"))
    return best.select("qid", "doc_id", "x.score", "x.via")


def z_score(score: Column, over: Window, least: float = 1e-6) -> Column:
    """Standard score within a list; 0 where it hardly varies."""
    spread = F.stddev_pop(score).over(over)
    return F.when(spread < least, F.lit(0.0)).otherwise((score - F.avg(score).over(over)) / spread)


def dynamic_k(df: DataFrame, drop: float) -> DataFrame:
    """Each ranked list up to the first fall of the score by more than ``drop``."""
    w = by_score()
    fall = F.when(F.lag("score").over(w) - F.col("score") > drop, 1).otherwise(0)
    return df.withColumn("_f", fall).withColumn("_s", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_s = 0").drop("_f", "_s")


def threshold_with_minimum(df: DataFrame, threshold: float, least: int) -> DataFrame:
    """Items at the threshold or above, but never fewer than the first ``least``."""
    return ranked(df).where((F.col("score") >= threshold) | (F.col("rank") <= least))


def score_margin(df: DataFrame, other: int = 3) -> DataFrame:
    """First score less the third, or the last if the list is shorter; 0 for one item."""
    r = ranked(df, other)
    return r.groupBy("qid").agg(F.max_by("score", F.struct(-F.col("rank"))).alias("top"), (F.max("score") - F.min("score")).alias("margin"))


def diverse_selection(df: DataFrame, k: int, per_group: int, group: str) -> DataFrame:
    """The first ``k`` with at most ``per_group`` of a group, then filled up in rank order."""
    inside = Window.partitionBy("qid", group).orderBy(F.desc("score"), "doc_id")
    first = df.withColumn("_over", (F.row_number().over(inside) > per_group).cast("int"))
    order = Window.partitionBy("qid").orderBy("_over", F.desc("score"), "doc_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_over")


def diverse_texts(df: DataFrame, k: int, bound: float, pool: int = 64) -> DataFrame:
    """``(qid, doc_id, score, place)``: the first ``k`` of the ``pool`` best of each list whose words differ.

    In order of the score an item is taken unless the Jaccard similarity of
    its words with an item taken before is above ``bound``; the places that
    are left go to the others in order. Items without words are never alike.
    Only the head of a list meets in one task, as neighbours in one array.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    head = ranked(df, pool).select("qid", "rank", "doc_id", "score", words.alias("w"))
    lists = head.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score", "w"))).alias("l"))
    empty = F.array().cast(lists.schema["l"].dataType)
    like = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    free = lambda taken, x: (F.size(taken) < k) & ~F.exists(taken, lambda y: like(x["w"], y["w"]) > bound)
    taken = F.aggregate("l", empty, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    rest = F.filter("l", lambda x: ~F.exists("t", lambda y: y["rank"] == x["rank"]))
    both = lists.withColumn("t", taken).select("qid", F.posexplode(F.slice(F.concat("t", rest), 1, k)).alias("p", "x"))
    return both.select("qid", "x.doc_id", "x.score", (F.col("p") + 1).alias("place"))


def running_totals(df: DataFrame, order: Sequence[str], size: Column | None = None) -> DataFrame:
    """``df`` with ``ahead``: the sum of ``size`` (rows by default) over all rows before each in ``order``.

    The rows are parted by ranges of the order and written; every part is
    summed by itself and shifted by the totals of the parts before it, so no
    task sorts the whole. Equal rows count in any order.
    """
    parts = written(df.withColumn("_s", F.lit(1) if size is None else size).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row per part
    shift = parts.groupBy("_p").agg(F.sum("_s").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    return parts.withColumn("_in", F.coalesce(F.sum("_s").over(inside), F.lit(0))).join(shift, "_p").withColumn("ahead", F.col("_in") + F.col("_shift")).drop("_s", "_p", "_in", "_shift")
