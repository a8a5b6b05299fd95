"""Same or nearly the same texts on both sides of an evaluation split.

Each distinct word set gets a similarity-hash fingerprint: the low eight bits
of many minwise hashes, concatenated. Fingerprints are joined on equal segments
across the sides, kept within a Hamming radius, and verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import spread, written

SEGMENTS, PER_SEGMENT = 44, 8


def words_of(text: Column) -> Column:
    """Sorted distinct words, in lower case and without punctuation."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")))


def _mixed(words: np.ndarray, width: int) -> np.ndarray:
    """``width`` independent 32-bit hashes of each word hash."""
    x = words.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def _fingerprints(segments: int, per_segment: int, slice_rows: int = 2000):
    """Adds ``keys``, one hash per segment, and ``bits``, five words of 64 low bits."""
    width = segments * per_segment
    weights = np.uint64(256) ** np.arange(per_segment, dtype=np.uint64)
    salt = np.arange(segments, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), slice_rows):
                batch = whole.iloc[start : start + slice_rows]
                sizes = np.array([len(w) for w in batch["words"]])
                known, at = np.unique(np.concatenate(list(batch["words"])).astype(np.uint32), return_inverse=True)
                hashes = _mixed(known, width)
                ends = np.cumsum(sizes)
                codes = np.empty((len(batch), width), np.uint8)
                for i, (a, b) in enumerate(zip(ends - sizes, ends)):
                    codes[i] = hashes[at[a:b]].min(axis=0).astype(np.uint8)
                keys = (codes.reshape(len(batch), segments, per_segment).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
                keys = (keys ^ salt) * np.uint64(0x9E3779B97F4A7C15)
                bits = np.packbits(codes[:, :320] & 1, axis=1).view(">u8").astype(np.uint64).view(np.int64)
                yield batch.assign(keys=list(keys.view(np.int64)), bits=list(bits))

    return run


def near_copies(texts: DataFrame, similarity: float = 0.75, min_words: int = 12, radius: int = 20, far_radius: int = 56, segments: int = SEGMENTS, per_segment: int = PER_SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Pairs of word sets across two sides, and the members of each set.

    ``texts(id bigint, side string, text)`` has the sides ``left`` and
    ``right``. Returns ``members(rep, id, side)`` of every set that is in a
    pair, and ``pairs(left_rep, right_rep, similarity)``; equal sets are a
    pair of a set with itself. ``rep`` is the smallest id of its set, so a
    group of copies is fingerprinted and joined once.

    A pair is found if ``per_segment`` neighbouring minwise hashes agree in one
    of ``segments`` places: with a share s of common words the chance to miss
    is (1 - s**8)**44, one in a hundred at 0.75 and one in 10,000 at 0.82.
    ``radius`` of 64 bits and ``far_radius`` of 256 bits lie over four standard
    deviations beyond the expected distance at 0.75; what they let through is
    verified on the words, as 32-bit hashes of all of them. Rows with a null id, side or text and sets
    below ``min_words`` have no part; repeated rows count once.
    """
    words = spread(texts.where(F.col("id").isNotNull() & F.col("side").isin("left", "right"))).select("id", "side", words_of(F.col("text")).alias("words"))
    words = words.where(F.size("words") >= min_words).select(
        "id", "side", F.unhex(F.md5(F.array_join("words", " "))).alias("set_key"), F.transform("words", lambda w: F.hash(w)).alias("words")
    )
    schema = "id bigint, side string, set_key binary, words array<int>, keys array<bigint>, bits array<bigint>"
    keyed = written(words.mapInPandas(_fingerprints(segments, per_segment), schema), "overlap-keyed")
    flags = keyed.groupBy("set_key").agg(
        F.min(F.struct("id", "side")).alias("first"),
        F.max(F.col("side") == "left").alias("left_side"),
        F.max(F.col("side") == "right").alias("right_side"),
    ).select("set_key", F.col("first.id").alias("rep"), F.col("first.side").alias("side"), "left_side", "right_side")
    flags = written(flags, "overlap-sets")
    prints = keyed.select("set_key", F.col("id").alias("rep"), "side", "keys", "bits").join(flags, ["set_key", "rep", "side"])
    prints = written(prints.dropDuplicates(["set_key"]).select("rep", "left_side", "right_side", "keys", "bits"), "overlap-prints")

    def blocks(side: str) -> DataFrame:
        return prints.where(f"{side}_side").select(F.explode("keys").alias("key"), F.col("rep").alias(f"{side}_rep"), F.element_at("bits", 1).alias(f"{side}_bits"))

    close = blocks("left").join(blocks("right"), "key").where((F.bit_count(F.col("left_bits").bitwiseXOR(F.col("right_bits"))) <= radius) & (F.col("left_rep") != F.col("right_rep")))
    close = close.select("left_rep", "right_rep").distinct()

    def codes(side: str) -> DataFrame:
        return prints.select(F.col("rep").alias(f"{side}_rep"), F.slice("bits", 2, 4).alias(f"{side}_code"))

    apart = F.aggregate(F.zip_with("left_code", "right_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    # words are fetched once, for the ends of the pairs that are left
    near = close.join(codes("left"), "left_rep").join(codes("right"), "right_rep").where(apart <= far_radius).select("left_rep", "right_rep")
    near = written(near, "overlap-near")
    used = near.select(F.explode(F.array("left_rep", "right_rep")).alias("rep")).distinct()
    sets = keyed.select(F.col("id").alias("rep"), "set_key", "words").join(used, "rep").join(flags.select("set_key", "rep"), ["set_key", "rep"]).dropDuplicates(["rep"])
    ends = near.select("left_rep", "right_rep", F.explode(F.array("left_rep", "right_rep")).alias("rep"))
    words = ends.join(sets.select("rep", "words"), "rep").groupBy("left_rep", "right_rep").agg(
        F.max(F.when(F.col("rep") == F.col("left_rep"), F.col("words"))).alias("left_words"), F.max(F.when(F.col("rep") == F.col("right_rep"), F.col("words"))).alias("right_words")
    )
    common = F.size(F.array_intersect("left_words", "right_words"))
    share = common / (F.size("left_words") + F.size("right_words") - common)
    pairs = words.select("left_rep", "right_rep", share.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    same = flags.where("left_side and right_side").select(F.col("rep").alias("left_rep"), F.col("rep").alias("right_rep"), F.lit(1.0).alias("similarity"))
    pairs = written(pairs.union(same), "overlap-pairs")
    used = pairs.select(F.col("left_rep").alias("rep")).union(pairs.select("right_rep")).distinct()
    members = keyed.select("set_key", "id", "side").distinct().join(flags.select("set_key", "rep").join(used, "rep"), "set_key").select("rep", "id", "side")
    return members, pairs


def query_texts(queries: DataFrame) -> DataFrame:
    """``(id, side, text)`` of evaluation queries: train is left, validation and test are right."""
    split = F.lower(F.trim("split"))
    side = F.when(split == "train", "left").when(split.isin("validation", "test"), "right")
    return queries.select(F.col("query_id").cast("bigint").alias("id"), side.alias("side"), F.col("clinical_context").alias("text"))


def split_overlaps(queries: DataFrame) -> DataFrame:
    """``(query_id_a, query_id_b)``, a < b, of every pair across the splits."""
    members, pairs = near_copies(query_texts(queries))
    left = members.where("side = 'left'").select(F.col("rep").alias("left_rep"), F.col("id").alias("left_id"))
    right = members.where("side = 'right'").select(F.col("rep").alias("right_rep"), F.col("id").alias("right_id"))
    both = pairs.join(left, "left_rep").join(right, "right_rep").where("left_id <> right_id")
    return both.select(F.least("left_id", "right_id").alias("query_id_a"), F.greatest("left_id", "right_id").alias("query_id_b")).distinct()


def overlap_report(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Per split and article: queries, and those with a copy across the splits.

    Pairs are not expanded: a query counts if its set is in a pair. The
    article is that of the matched case; a case that is listed under several
    articles or none is counted by the head of its id.
    """
    from caseloom.operators.grouped_split import case_article

    members, _ = near_copies(query_texts(queries))
    hit = members.select(F.col("id").alias("query_id")).distinct().withColumn("hit", F.lit(1))
    q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.lower(F.trim("split")).alias("split"), F.regexp_replace(F.upper(F.trim("case_id")), "-", "_").alias("case_key")).distinct()
    one = cases.select(F.regexp_replace(F.upper(F.trim("case_id")), "-", "_").alias("case_key"), F.regexp_extract("article_id", r"([0-9]{9})", 1).alias("a")).where("a <> ''")
    one = one.groupBy("case_key").agg(F.min("a").alias("a"), F.max("a").alias("z")).where("a = z").select("case_key", F.concat(F.lit("PMC"), "a").alias("listed"))
    full = q.join(one, "case_key", "left").join(hit, "query_id", "left").withColumn("article", F.coalesce("listed", case_article(F.col("case_key"))))
    return full.groupBy("split", "article").agg(F.count("*").alias("queries"), F.count("hit").alias("overlapping"))
