"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut


def _neighbour_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the smallest of u and all its v.

    The minimum is pre-aggregated before its shuffle, so a hub costs one row
    for each task; the join back is an ordinary equi-join that adaptive
    execution splits when a hub is hot.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` per node that has an edge.

    ``component`` is the smallest node of the component in the order of the
    column's type. Alternates large-star and small-star steps until the set of
    edges stands still; each round is checkpointed. Null ends and loops are
    ignored, repeated edges count once, and no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    stars = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(stars)
    while before[0]:
        both = stars.union(stars.select("v", "u")).toDF("u", "v")
        large = _neighbour_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _neighbour_min(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", "m")).where("u <> v").distinct()
        stars = cut(small)
        after = state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v")).distinct()
