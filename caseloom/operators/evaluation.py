"""Measures of ranked lists and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def retrieval_metrics(run: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per judged query: recall, precision and nDCG at each k, MRR and AP.

    ``run(qid, doc_id, rank)`` and ``qrels(qid, doc_id, grade)`` are joined on
    query and document, so both may be long. Precision divides by what was
    retrieved up to k; the ideal of nDCG comes from all judgements. Queries
    without judgements are left out; those without results score 0.
    """
    judged = qrels.where("grade > 0")
    hits = run.join(judged, ["qid", "doc_id"], "left").select("qid", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("seen", F.sum((F.col("grade") > 0).cast("int")).over(w))
    got = hits.groupBy("qid").agg(
        F.coalesce(F.max(F.when(F.col("grade") > 0, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("grade") > 0, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        *[F.count_if((F.col("rank") <= k) & (F.col("grade") > 0)).alias(f"hit_{k}") for k in ks],
        *[F.count_if(F.col("rank") <= k).alias(f"got_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
    )
    ideal_rank = judged.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal_rank.groupBy("qid").agg(
        F.count("*").alias("relevant"), *[F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"idcg_{k}") for k in ks]
    )
    full = ideal.join(got, "qid", "left").fillna(0)
    out = [F.col("qid"), F.col("mrr"), (F.col("ap_sum") / F.col("relevant")).alias("ap")]
    for k in ks:
        out += [
            (F.col(f"hit_{k}") / F.col("relevant")).alias(f"recall_{k}"),
            F.coalesce(F.try_divide(F.col(f"hit_{k}"), F.col(f"got_{k}")), F.lit(0.0)).alias(f"precision_{k}"),
            F.coalesce(F.try_divide(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")), F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    return full.select(*out)


def hash_unit(*parts: Column) -> Column:
    """A number of [0, 1) from the MD5 of the parts, the same on any engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bootstrap_means(values: DataFrame, group: str, unit: str, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """``(group, replicate, mean)`` under the Bayesian bootstrap.

    Each unit weighs -ln(u) in a replicate, u from a hash of seed, replicate
    and unit. One pass and one aggregation: no resampling by position, nothing
    is collected, and only ``replicates`` rows per group remain.
    """
    r = values.where(F.col(value).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = -F.log(F.greatest(hash_unit(F.lit(seed), F.col("replicate"), F.col(unit)), F.lit(1e-12)))
    return r.withColumn("_w", w).groupBy(group, "replicate").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mean"))


def hierarchical_means(values: DataFrame, group: str, case: str, run: str, value: str, replicates: int, seed: int = 42, draw: int = 7) -> DataFrame:
    """``(group, replicate, mean)``: in each replicate one run of each case is drawn and the cases are weighted.

    The draw takes the run with the smallest hash of replicate, case, group
    and run; the weights are those of ``bootstrap_means``.
    """
    r = values.where(F.col(value).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = hash_unit(F.lit(draw), F.col("replicate"), F.col(case), F.col(group), F.col(run))
    one = r.groupBy(group, case, "replicate").agg(F.min_by(value, F.struct(u, F.col(run))).alias("_x"))
    w = -F.log(F.greatest(hash_unit(F.lit(seed), F.col("replicate"), F.col(case)), F.lit(1e-12)))
    return one.withColumn("_w", w).groupBy(group, "replicate").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"))


def recall_of_indices(df: DataFrame, points: str, indices: str) -> DataFrame:
    """``df`` with ``total``, ``matched``, ``recall`` and the ``unmatched`` points.

    ``indices`` number the points from 1. Numbers outside the list, nulls and
    repeats do not count; without points the recall is 0.
    """
    p, i = F.coalesce(F.col(points), F.array().cast(df.schema[points].dataType)), F.coalesce(F.col(indices), F.array().cast(df.schema[indices].dataType))
    valid = F.array_distinct(F.filter(i, lambda x: x.between(1, F.size(p))))
    missed = F.filter(F.transform(p, lambda x, k: F.when(~F.array_contains(valid, (k + 1).cast(df.schema[indices].dataType.elementType)), x)), lambda x: x.isNotNull())
    return df.withColumn("total", F.size(p)).withColumn("matched", F.size(valid)).withColumn("recall", F.coalesce(F.try_divide(F.size(valid), F.size(p)), F.lit(0.0))).withColumn("unmatched", missed)


def confidence_interval(means: DataFrame, group: str, confidence: float = 0.95) -> DataFrame:
    """Bounds by the index rule: ``int(alpha * n)`` and ``int((1 - alpha) * n) - 1``."""
    alpha = (1 - confidence) / 2
    s = means.groupBy(group).agg(F.array_sort(F.collect_list("mean")).alias("m"), F.count("*").alias("n"))
    low = F.least(F.floor(F.col("n") * alpha).cast("int"), F.col("n").cast("int") - 1)
    high = F.greatest(F.lit(0), F.floor(F.col("n") * (1 - alpha)).cast("int") - 1)
    return s.select(group, F.element_at("m", low + 1).alias("low"), F.element_at("m", high + 1).alias("high"))


def sign_flip_p(deltas: DataFrame, group: str, unit: str, delta: str, permutations: int, seed: int = 42) -> DataFrame:
    """Two-sided paired permutation p with one added to both counts."""
    sign = F.when(hash_unit(F.lit(seed), F.col("permutation"), F.col(unit)) < 0.5, -1.0).otherwise(1.0)
    flipped = deltas.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("_d", sign * F.col(delta))
    means = flipped.groupBy(group, "permutation").agg(F.abs(F.avg("_d")).alias("m"))
    seen = deltas.groupBy(group).agg(F.abs(F.avg(delta)).alias("observed"), F.avg(delta).alias("mean_delta"))
    return means.join(seen, group).groupBy(group, "mean_delta").agg(((F.count_if(F.col("m") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))


def holm(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """Monotone Holm-Bonferroni adjustment over a table of tests (a few rows)."""
    order = Window.orderBy(p, name)
    step = F.col(p) * (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1)
    return tests.withColumn("_s", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
