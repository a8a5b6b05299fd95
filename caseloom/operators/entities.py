"""Dictionary entities in texts, and node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import spread


def dictionary_mentions(documents: DataFrame, id_col: str, text: str, dictionary: DataFrame, term: str, entity: str, longest: int = 6) -> DataFrame:
    """``(doc_id, entity, term, mentions)`` of whole-word terms of up to ``longest`` words.

    Every run of one to ``longest`` words meets the dictionary in an equi-join,
    so text length and dictionary size do not multiply; runs are counted within
    the document first.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    d = spread(documents.select(id_col, text)).select(F.col(id_col).alias("doc_id"), words.alias("_w")).where(F.size("_w") > 0)
    sizes = dictionary.select(F.array_join(F.filter(F.split(F.lower(F.col(term)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ").alias("term"), F.col(entity).alias("entity")).where("term <> ''").distinct()
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("_w")),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i + 1)), lambda n: F.array_join(F.slice("_w", i, n), " ")),
        )
    )
    counted = d.select("doc_id", F.explode(runs).alias("term")).join(sizes, "term")
    return counted.groupBy("doc_id", "entity", "term").agg(F.count("*").alias("mentions"))


def nodes(mentions: DataFrame) -> DataFrame:
    """``(entity, documents, mentions, terms)``: one node per entity."""
    return mentions.groupBy("entity").agg(F.count_distinct("doc_id").alias("documents"), F.sum("mentions").alias("mentions"), F.array_sort(F.collect_set("term")).alias("terms"))


def edges(mentions: DataFrame) -> DataFrame:
    """``(doc_id, entity)``: which document names which entity."""
    return mentions.select("doc_id", "entity").distinct()


def rare(df: DataFrame, value: str, key: str, most: int = 3) -> DataFrame:
    """Values that at most ``most`` keys have."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_distinct(key).alias("keys")).where(F.col("keys") <= most)
