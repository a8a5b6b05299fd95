"""Train, validation and test splits that keep tied records together.

Grouped iterative stratification: the connected components of the records'
article ids are the units, each with a vector of label counts. The labels are
taken by what is still outstanding, the rarest first, and all components that
hold the label go to the splits that need it most. Components that hold as
many records of the label as each other are dealt as one class.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.components import connected_components
from caseloom.session import cut

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def article_key(raw: Column) -> Column:
    """``PMC`` and nine digits of an article id in any spelling, or null.

    Blanks, letter case, separators, leading zeros, a missing prefix and a
    version suffix are ignored. A value without such a number gives null.
    """
    digits = F.regexp_extract(F.lower(raw), r"^\s*(?:pmcid)?[\s:]*(?:pmc)?[\s:_\-]*0*([1-9][0-9]{0,8})(?:\.[0-9]+)?\s*$", 1)
    return F.when(F.length(digits) > 0, F.concat(F.lit("PMC"), F.lpad(digits, 9, "0")))


def case_article(raw: Column) -> Column:
    """The article id at the head of a case id, or null."""
    digits = F.regexp_extract(F.lower(raw), r"^\s*(?:pmcid)?[\s:]*(?:pmc)?[\s:\-]*0*([1-9][0-9]{0,8})\s*[_\-][^_]*$", 1)
    return F.when(F.length(digits) > 0, F.concat(F.lit("PMC"), F.lpad(digits, 9, "0")))


def record_groups(records: DataFrame, row_id: str = "row_id", article: str = "article_id", case: str = "case_id") -> DataFrame:
    """``records`` and the column ``group_article``.

    Two records share a group if an article is named in both, in either
    column, and along chains. A record that names no article is a group of its
    own, with null as ``group_article`` and its row id as ``group_key``.
    Records are kept as they are, repeated ones too.
    """
    keyed = records.withColumn("_a", article_key(F.col(article))).withColumn("_c", case_article(F.col(case)))
    roots = connected_components(keyed.select(F.col("_a").alias("src"), F.col("_c").alias("dst")))
    named = keyed.withColumn("_n", F.coalesce("_c", "_a"))
    out = named.join(roots, named["_n"] == roots["node"], "left")
    group = F.coalesce(F.col("component"), F.col("_n"))
    return out.withColumn("group_article", group).withColumn(
        "group_key", F.coalesce(group, F.concat(F.lit("row:"), F.col(row_id).cast("string")), F.lit("row:"))
    ).drop("_a", "_c", "_n", "node", "component")


def _ranked(units: DataFrame, size: str, count: int, bucket_rows: int = 50_000) -> DataFrame:
    """``units`` with ``rank``: how many units of the same ``size`` lie ahead of each in hash order.

    Hash buckets of about ``bucket_rows`` units are ranked apart and then
    shifted by the counts of the buckets ahead of them, so no task sorts a
    whole class however large it is.
    """
    spread = units.withColumn("_h", F.xxhash64("group_key")).withColumn("_b", F.pmod("_h", F.lit(max(1, count // bucket_rows))))
    inside = Window.partitionBy(size, "_b").orderBy("_h", "group_key")
    ahead = Window.partitionBy(size).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    shift = spread.groupBy(size, "_b").agg(F.count("*").alias("_c")).select(size, "_b", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_shift"))
    return spread.withColumn("_in", F.row_number().over(inside) - 1).join(shift, [size, "_b"]).withColumn("rank", F.col("_in") + F.col("_shift")).drop("_h", "_b", "_in", "_shift")


def _deal(members: int, n: int, want: dict[str, float], order: list[str]) -> dict[str, int]:
    """How many of ``members`` equal units of ``n`` records each split gets.

    One unit after another goes to the split with the greatest need, the first
    in ``order`` of equals. All but a few are dealt at once: down to the level
    of need that lets the needs meet.
    """
    low, high = min(want.values()) - n * members, max(want.values())
    for _ in range(100):
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0, math.floor((w - level) / n)) for w in want.values()) > members else (low, level)
    got = {s: max(0, math.floor((want[s] - high) / n)) for s in order}
    for _ in range(members - sum(got.values())):
        s = max(order, key=lambda s: want[s] - n * got[s])
        got[s] += 1
    return got


def stratify_groups(groups: DataFrame, label: str, proportions: Mapping[str, float] = SPLITS, max_labels: int = 10_000) -> DataFrame:
    """``(group_key, split)`` for the groups of ``groups(group_key, label)``.

    The labels are taken by their outstanding records, the rarest first.
    Components with the same number of records of that label are a class; the
    classes go from the largest number to the smallest, and the members of a
    class go one by one into the split with the greatest need. How many each
    split gets is counted on the driver from one row per class, of which there
    are at most the square root of twice the records; which ones is read off
    their rank in hash order. A null label is a label of its own. Each label
    takes a pass; more than ``max_labels`` are an error.
    """
    names = sorted(proportions, key=lambda s: (-proportions[s], s))
    total_share = sum(proportions.values())
    vectors = cut(
        groups.select("group_key", F.coalesce(F.initcap(F.trim(F.col(label))), F.lit("")).alias("label")).groupBy("group_key", "label").agg(F.count("*").alias("n"))
    )
    totals = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.sum("n").alias("n")).limit(max_labels + 1).collect()}
    if len(totals) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    need = {s: {x: proportions[s] / total_share * n for x, n in totals.items()} for s in names}
    outstanding, left = dict(totals), vectors
    placed = []
    while outstanding := {x: n for x, n in outstanding.items() if n > 0}:
        rarest = min(outstanding, key=lambda x: (outstanding[x], x))
        units = left.where(F.col("label") == rarest).select("group_key", "n")
        classes = sorted((r["n"], r["members"]) for r in units.groupBy("n").agg(F.count("*").alias("members")).collect())[::-1]
        want = {s: need[s][rarest] for s in names}
        bounds = []
        for n, members in classes:
            got = _deal(members, n, want, names)
            at = 0
            for s in names:
                want[s] -= n * got[s]
                if got[s]:
                    bounds.append((n, at, at + got[s], s))
                at += got[s]
        shares = vectors.sparkSession.createDataFrame(bounds, "n bigint, first bigint, stop bigint, split string")
        ranked = _ranked(units, "n", sum(m for _, m in classes))
        chosen = cut(ranked.join(shares, "n").where("rank >= first and rank < stop").select("group_key", "split"))
        placed.append(chosen)
        for r in left.join(chosen, "group_key").groupBy("split", "label").agg(F.sum("n").alias("n")).collect():  # splits times labels
            need[r["split"]][r["label"]] -= r["n"]
            outstanding[r["label"]] -= r["n"]
        left = left.join(chosen, "group_key", "left_anti")
        if len(placed) % 4 == 0:
            left = cut(left)
    out = vectors.sparkSession.createDataFrame([], "group_key string, split string")
    for x in placed:
        out = out.union(x)
    return out


def grouped_split(records: DataFrame, row_id: str = "row_id", article: str = "article_id", case: str = "case_id", label: str = "leish_type", proportions: Mapping[str, float] = SPLITS) -> DataFrame:
    """One row ``(row_id, group_article, split)`` per distinct record.

    All records of a group get the same split. Nulls: a null article or case
    names nothing; a null label is a label of its own; rows with a null row id
    are kept and grouped by their articles. Empty input gives no rows. Extra
    columns are ignored.
    """
    need = records.select(F.col(row_id).alias("row_id"), F.col(article).alias("_article"), F.col(case).alias("_case"), F.col(label).alias("_label"))
    once = need.distinct()
    groups = cut(record_groups(once, "row_id", "_article", "_case").select("row_id", "group_article", "group_key", "_label"))
    splits = stratify_groups(groups, "_label", proportions)
    return groups.join(splits, "group_key").select("row_id", "group_article", "split").distinct()


def split_report(assigned: DataFrame, records: DataFrame, row_id: str = "row_id", label: str = "leish_type", proportions: Mapping[str, float] = SPLITS) -> DataFrame:
    """Records, groups, reached share and its distance from the target, of each split and label."""
    labelled = records.select(F.col(row_id).alias("row_id"), F.coalesce(F.initcap(F.trim(F.col(label))), F.lit("")).alias("label")).distinct()
    per = assigned.join(labelled, "row_id").groupBy("label", "split").agg(F.count("*").alias("records"), F.count_distinct("group_article").alias("groups"))
    share = F.col("records") / F.sum("records").over(Window.partitionBy("label"))
    target = F.element_at(F.create_map(*[F.lit(x) for s, p in proportions.items() for x in (s, p / sum(proportions.values()))]), F.col("split"))
    return per.withColumn("share", share).withColumn("deviation", F.col("share") - target)
