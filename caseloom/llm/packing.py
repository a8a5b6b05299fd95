"""Packing of texts into containers of a fixed token capacity.

Best-fit decreasing with conflicts: open containers are kept in the order of
their free room and carry bitmaps of the duplicate clusters and sources they
hold; the search goes on from the tightest container that fits until one is
compatible.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import written

CAPACITY = 4096


def best_fit(items: list[tuple[int, str, str]], capacity: int) -> list[int]:
    """The container of each item ``(size, cluster, source)``, sizes of 1 to ``capacity``.

    Items of one cluster never share a container. Of equally tight containers
    one without the item's source is taken first. Larger items go first; ties
    keep the order given. Clusters of more than twice the square root of all
    items go before the others: for each the containers that are free of it
    are one list, from which the tightest that fits is taken out, so a search
    never walks over containers that hold a copy already.
    """
    counts: dict[str, int] = {}
    for _, cluster, _ in items:
        counts[cluster] = counts.get(cluster, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in counts.items() if n > 1)}
    source_bit: dict[str, int] = {}
    clusters, sources = [], []  # bitmaps per container
    rooms: list[tuple[int, int]] = []  # (free room, container), in order
    placed = [0] * len(items)
    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    hot = {c: [] for c, n in counts.items() if n > 2 * math.sqrt(len(items)) + 8}
    for i in order:
        if items[i][1] in hot:
            hot[items[i][1]].append(i)
    for cluster, members in sorted(hot.items(), key=lambda x: (-len(x[1]), x[0])):
        free, room_of = list(rooms), {b: room for room, b in rooms}
        for i in members:
            size, _, source = items[i]
            at = bisect_left(free, (size, -1))
            if at < len(free):
                room, b = free.pop(at)
            else:
                b, room = len(clusters), capacity
                clusters.append(0)
                sources.append(0)
            clusters[b] |= cluster_bit[cluster]
            sources[b] |= source_bit.setdefault(source, 1 << len(source_bit))
            placed[i], room_of[b] = b, room - size
        rooms = sorted((room, b) for b, room in room_of.items() if room > 0)
    for i in order:
        size, cluster, source = items[i]
        if cluster in hot:
            continue
        bit, own = cluster_bit.get(cluster, 0), source_bit.setdefault(source, 1 << len(source_bit))
        found, at = -1, bisect_left(rooms, (size, -1))
        while at < len(rooms):
            room, b = rooms[at]
            if found >= 0 and room > rooms[found][0]:
                break
            if not clusters[b] & bit:
                if not sources[b] & own:
                    found = at
                    break
                if found < 0:
                    found = at
            at += 1
        if found < 0:
            b, room = len(clusters), capacity
            clusters.append(0)
            sources.append(0)
        else:
            room, b = rooms.pop(found)
        clusters[b] |= bit
        sources[b] |= own
        placed[i] = b
        if room > size:
            insort(rooms, (room - size, b))
    return placed


def pack(sizes: DataFrame, capacity: int = CAPACITY, group_tokens: int = 4_000_000) -> DataFrame:
    """``(container, doc_id, piece, first_token, tokens)`` for ``token_sizes`` rows.

    A text of more than ``capacity`` tokens is cut into full pieces, which
    fill a container each, and a rest that is packed like other texts; every
    other text is one piece. The texts are dealt by hash into groups of about
    ``group_tokens`` tokens, so a task packs a bounded number of them however
    large the corpus, and every group has the same mix of lengths; each group
    leaves about one container part empty.
    """
    total = sizes.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(total / group_tokens))
    pieces = (
        sizes.withColumn("full", F.floor(F.col("tokens") / capacity).cast("int"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.when((F.col("tokens") % capacity == 0), F.col("full") - 1).otherwise(F.col("full")))))
        .select(F.col("doc_id").cast("string").alias("doc_id"), "source", "cluster", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"))
        .withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    )
    whole = pieces.where(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"), "doc_id", "piece", "first_token", "tokens")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "cluster"], kind="stable")
        bins = best_fit(list(zip(pdf["tokens"].tolist(), [f"{c}/{p}" for c, p in zip(pdf["cluster"], pdf["piece"])], pdf["source"].tolist())), capacity)
        g = pdf["g"].iloc[0] if len(pdf) else 0
        return pd.DataFrame({"container": [f"{g}-{b}" for b in bins], "doc_id": pdf["doc_id"].tolist(), "piece": pdf["piece"].tolist(), "first_token": pdf["first_token"].tolist(), "tokens": pdf["tokens"].tolist()})

    rest = pieces.where(F.col("tokens") < capacity).groupBy("g").applyInPandas(run, "container string, doc_id string, piece int, first_token bigint, tokens bigint")
    return written(whole.union(rest).withColumn("doc_id", F.col("doc_id").cast("bigint")), "packed")  # ids were text, as nulls beside them make floats of numbers


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers by how full they are, in twentieths, with their tokens and free room."""
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    level = F.ceil(F.col("tokens") * 20 / capacity).cast("int")
    return bins.groupBy(level.alias("twentieths_full")).agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum(F.lit(capacity) - F.col("tokens")).alias("free_tokens")
    )
