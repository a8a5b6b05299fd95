"""Mixing of sources to target shares of all tokens.

Each source gets the whole copies that are certain; the rest of its tokens is
drawn by Pareto order sampling: texts are ranked by random odds divided by
their inclusion odds, and the first ones that fill the size are taken.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import written


def distinct_texts(sizes: DataFrame, last: Column) -> DataFrame:
    """One row of ``token_sizes`` per text: of copies, the one with the smallest id, those that are ``last`` after all others."""
    first = sizes.groupBy("cluster").agg(F.min(F.struct(last.alias("last"), "doc_id", "source", "tokens")).alias("x"))
    return first.select("x.doc_id", "x.source", "x.tokens")


def _inclusion_scale(histogram: list[tuple[float, float]], size: float, power: float) -> float:
    """c with sum of n * t * min(1, c * t**power) = size over ``(tokens t, texts n)``."""
    low, high = 0.0, 1.0
    reached = lambda c: sum(n * t * min(1.0, c * t**power) for t, n in histogram)
    while reached(high) < size and high < 1e12:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < size else (low, middle)
    return high


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, power: float = 0.5, seed: int = 17, buckets: int = 1024, edge_texts: int = 50_000, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, tokens, copies)`` of the mix, and the report per source.

    ``targets(source, target_share, max_repeats)``; a null repeat cap counts as
    one, sources without a target are not used, those without texts reach a
    share of 0, and the shares of the others are scaled to 1. Without
    ``total_tokens`` the mix is as large as the scarcest source allows.
    The texts are taken in Pareto order as long as they fit the size; then
    later ones that fit what is missing, so that a source ends short of its
    size by less than the texts that are left. The report compares the share
    reached with the target and with the target scaled to the sources that
    have texts.
    The inclusion probability of a text grows with ``tokens ** power``. Texts
    are counted once however many documents repeat them, so no text is used
    more than ``max_repeats`` times; of copies in target sources the one with
    the smallest id counts, with its source, those in a source with no share or
    a cap of 0 after all others. Draws depend on ``doc_id`` and ``seed``
    only.
    """
    spark = sizes.sparkSession
    goal = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("cap"))
    goals = {r["source"]: (float(r["share"] or 0), int(r["cap"])) for r in goal.where("source is not null").limit(max_sources + 1).collect()}
    if len(goals) > max_sources:
        raise ValueError(f"more than {max_sources} sources with a target")
    # copies in other sources are left out before the choice: a text is lost only if no copy stands in a target source
    targeted = sizes.where(F.col("source").isin(list(goals)) if goals else F.lit(False))
    unusable = F.col("source").isin([s for s, (share, cap) in goals.items() if share <= 0 or cap <= 0])
    texts = written(distinct_texts(targeted, unusable), "mix-texts")
    # three significant digits: at most 900 rows for each source and power of ten
    digits = F.greatest(F.lit(0), F.floor(F.log10("tokens")) - 2)
    coarse = F.round(F.col("tokens") / F.pow(F.lit(10.0), digits)) * F.pow(F.lit(10.0), digits)
    shape: dict[str, list[tuple[float, float]]] = {}
    have: dict[str, int] = {}
    for r in texts.groupBy("source", coarse.alias("t")).agg(F.count("*").alias("n"), F.sum("tokens").alias("all")).collect():
        shape.setdefault(r["source"], []).append((r["all"] / r["n"], r["n"]))
        have[r["source"]] = have.get(r["source"], 0) + r["all"]
    usable = {s: goals[s][0] for s in have if goals[s][0] > 0 and goals[s][1] > 0 and have[s] > 0}
    scale = sum(usable.values())
    shares = {s: x / scale for s, x in usable.items()}
    if total_tokens is None:
        total_tokens = int(min((goals[s][1] * have[s] / shares[s] for s in shares), default=0))
    plan = []
    for s, share in shares.items():
        wanted = min(share * total_tokens, goals[s][1] * have[s])
        whole = min(int(wanted // have[s]), goals[s][1])
        rest = wanted - whole * have[s]
        rest = 0.0 if whole >= goals[s][1] else rest
        plan.append((s, whole, float(rest), _inclusion_scale(shape[s], rest, power) if rest > 0 else 0.0))
    rows = spark.createDataFrame(plan, "source string, whole int, rest double, c double")  # one row per target source
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(2.0**53)
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("c") * F.pow(F.col("tokens").cast("double"), F.lit(power))))
    odds = (u / (1 - u)) / (p / (1 - p))
    ranked = texts.join(F.broadcast(rows), "source").withColumn("q", odds).withColumn("place", F.col("q") / (1 + F.col("q")))
    ranked = written(ranked, "mix-ranked")
    # the order is summed by bucket, and the bucket in which a source's size is reached is parted again until it is small enough to sort
    rest = {s: r for s, _, r, _ in plan if r > 0}
    span = {s: (0.0, 1.0, 0.0) for s in rest}  # first place, end, tokens ahead
    open_ = set(rest)
    while open_:
        bounds = spark.createDataFrame([(s, *span[s][:2]) for s in sorted(open_)], "source string, low double, high double")
        inside = ranked.join(F.broadcast(bounds), "source").where("place >= low and place < high")
        step = F.least(F.lit(buckets - 1), F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low")) * buckets)).cast("int")
        got: dict[str, list] = {}
        for r in inside.groupBy("source", step.alias("b")).agg(F.sum("tokens").alias("n"), F.count("*").alias("texts")).collect():  # buckets times sources
            got.setdefault(r["source"], []).append((r["b"], r["n"], r["texts"]))
        for s in list(open_):
            low, high, ahead = span[s]
            for b, n, count in sorted(got.get(s, [])):
                if ahead + n > rest[s]:
                    wide = (high - low) / buckets
                    span[s] = (low + b * wide, high if b == buckets - 1 else low + (b + 1) * wide, ahead)
                    if count <= edge_texts or wide < 1e-13:
                        open_.discard(s)
                    break
                ahead += n
            else:  # all texts of the source fit
                span[s] = (high, high, ahead)
                open_.discard(s)
    edge = spark.createDataFrame([(s, *x) for s, x in span.items()], "source string, low double, high double, filled double")
    cut_at = ranked.join(F.broadcast(edge), "source")
    order = Window.partitionBy("source").orderBy("q", "doc_id")
    at_edge = cut_at.where("place >= low and place < high").withColumn("sum", F.sum("tokens").over(order))
    first = written(
        at_edge.where(F.col("filled") + F.col("sum") <= F.col("rest")).select("doc_id", "source", "tokens").union(cut_at.where("place < low").select("doc_id", "source", "tokens")), "mix-drawn"
    )
    # what is still missing is less than the next text: the nearest later ones that fit are taken in their order
    missing = {s: rest[s] - n for s, n in {**{s: 0 for s in rest}, **{r["source"]: r["n"] for r in first.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}}.items()}
    gaps = spark.createDataFrame([(s, float(n)) for s, n in missing.items()], "source string, gap double")
    later = ranked.join(F.broadcast(gaps), "source").where(F.col("tokens") <= F.col("gap")).join(first.select("doc_id"), "doc_id", "left_anti")
    near = later.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 500).select("source", "k", "doc_id", "tokens").collect()  # at most 500 a source
    more = []
    for r in sorted(near, key=lambda r: (r["source"], r["k"])):
        if r["tokens"] <= missing[r["source"]]:
            missing[r["source"]] -= r["tokens"]
            more.append((r["doc_id"], r["source"]))
    drawn = first.select("doc_id", "source").union(spark.createDataFrame(more, "doc_id bigint, source string")).withColumn("extra", F.lit(1))
    chosen = ranked.select("doc_id", "source", "tokens", "whole").join(drawn, ["doc_id", "source"], "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    mixed = written(chosen.where("copies > 0").select("doc_id", "source", "tokens", "copies"), "mixed")
    used = mixed.groupBy("source").agg(F.count("*").alias("texts_used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    there = texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))
    whole_mix = used.agg(F.sum("tokens_used").alias("all_tokens"))
    report = (
        goal.where("source is not null").join(there, "source", "left").join(used, "source", "left").crossJoin(F.broadcast(whole_mix))  # one row
        .select(
            "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("texts_used", F.lit(0)).alias("texts_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce(F.col("tokens_used") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
        )
        .join(F.broadcast(spark.createDataFrame([(s, x) for s, x in shares.items()], "source string, scaled_share double")), "source", "left")  # one row per target source
        .withColumn("scaled_share", F.coalesce("scaled_share", F.lit(0.0)))
        .withColumn("deviation", F.col("reached_share") - F.col("scaled_share"))
    )
    return mixed, report
