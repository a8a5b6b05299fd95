"""Mapping of freely typed values to the entries of a reference list.

Values are deduplicated and normalised, candidates come from an inverted index
over character grams, their score is an inverse-frequency weighted cosine, and
a candidate is accepted above a threshold and a margin to the next entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import spread, written

# Words that hedge or annotate a value and name nothing themselves.
QUALIFIERS = [
    "most consistent with", "not yet confirmed", "consistent with", "compatible with", "suggestive of", "in favour of", "high confidence",
    "low confidence", "moderate confidence", "see image", "see images", "rule out", "possibly", "possible", "probably", "probable", "presumed",
    "suspected", "likely", "confirmed", "recurrent", "query", "rank 1", "dx", "ddx", "r/o", "diagnosis of", "diagnosis",
]


def normalised(raw: Column) -> Column:
    """Lower case, no accents or markup, one blank between words, no qualifiers.

    Dotted abbreviations are joined (``C.L.`` is ``cl``). Text in round
    brackets stays unless it is a qualifier; text in square brackets goes.
    """
    x = F.lower(F.regexp_replace(raw, r"[\x00-\x1f ​﻿]", " "))
    x = F.translate(x, "áàâäãåéèêëíìîïóòôöõúùûüçñ’‘", "aaaaaaeeeeiiiiooooouuuucn''")
    x = F.regexp_replace(x, r"\[[^\]]*\]|</?[a-z]+>", " ")
    x = F.regexp_replace(x, r"(?<=[a-z])'s\b|s'(?=\s|$)", "")
    x = F.regexp_replace(x, r"(?<![a-z])((?:[a-z]{1,2}\.){2,}[a-z]?)(?![a-z])", " $1 ")
    x = F.regexp_replace(x, r"(?<=(?<![a-z])[a-z]{1,2})\.(?=[a-z]{1,2}(?:\.|$|\s))", "")
    x = F.regexp_replace(x, r"\b(?:stage|grade|type|form)\s+(?:[0-9]+|[ivx]+)\b", " \u0001 ")
    words = "|".join(q.replace(" ", r"\s+") for q in sorted(QUALIFIERS, key=len, reverse=True))
    x = F.regexp_replace(x, rf"(?<![a-z])(?:{words})(?![a-z])", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}]+|\b(?:of|the|in|on|a)\b", " ")
    x = F.regexp_replace(x, r" {2,}", " ")
    return F.trim(x)


def _code(raw: Column) -> Column:
    """A word that qualifies the next one (``type CL``) is dropped."""
    return F.regexp_replace(raw, r"^(?:type|form|class|group)\s+(?=\S)", "")


def _grams(text: Column) -> Column:
    """Distinct bigrams with edges, and unordered letter pairs two apart.

    Blanks are left out, so joined and parted words give nearly the same
    grams; the unordered pairs keep their value when neighbours are swapped.
    """
    padded = F.concat(F.lit("^"), F.replace(text, F.lit(" "), F.lit("")), F.lit("$"))
    n = F.length(padded)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(2)))
    skips = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: F.concat(F.lit("~"), F.array_join(F.array_sort(F.array(F.substring(padded, i, F.lit(1)), F.substring(padded, i + 2, F.lit(1)))), "")),
    )
    return F.array_distinct(F.concat(pairs, skips))


def reference_index(catalog: DataFrame, list_col: str = "list_name", id_col: str = "entry_id", name_col: str = "canonical_name", alias_col: str = "aliases") -> DataFrame:
    """``(list, entry_id, form, is_name)``: the names and aliases of each entry, normalised."""
    c = catalog.select(F.col(list_col).alias("list"), F.col(id_col).cast("bigint").alias("entry_id"), F.col(name_col).alias("_n"), F.coalesce(F.col(alias_col), F.array().cast("array<string>")).alias("_a"))
    forms = c.select("list", "entry_id", F.col("_n").alias("raw"), F.lit(0).alias("rank")).union(c.select("list", "entry_id", F.explode("_a"), F.lit(1)))
    forms = forms.withColumn("form", normalised("raw")).where(F.length("form") > 0)
    return forms.groupBy("list", "form").agg(F.min_by("entry_id", F.struct("rank", "entry_id")).alias("entry_id"), F.min("rank").alias("rank"), F.max(F.length("raw")).alias("raw_length"))


def _dictionary(index: DataFrame) -> DataFrame:
    """``(list, token, full)``: short forms of words of the list and of its codes.

    A prefix of three letters or more stands for the word that most forms
    begin with it, unless two words tie; a one-word form of up to five letters
    stands for the longest form of its entry when it is part of a longer value.
    """
    words = index.select("list", F.explode(F.split("form", " ")).alias("full")).groupBy("list", "full").agg(F.count("*").alias("n"))
    prefixes = words.where(F.length("full") > 4).select("list", "full", "n", F.explode(F.expr("sequence(3, length(full) - 1)")).alias("k")).withColumn("token", F.expr("substring(full, 1, k)"))
    known = words.select("list", F.col("full").alias("token"))
    best = Window.partitionBy("list", "token").orderBy(F.desc("n"), "full")
    short = (
        prefixes.join(known, ["list", "token"], "left_anti")
        .withColumn("r", F.row_number().over(best))
        .withColumn("next", F.lead("n").over(best))
        .where("r = 1 and (next is null or next < n)")
        .select("list", "token", "full")
    )
    whole = index.groupBy("list", "entry_id").agg(F.max_by("form", F.struct(F.when(F.col("rank") == 0, 1).otherwise(0), F.length("form"))).alias("full"), F.collect_set("form").alias("forms"))
    codes = (
        whole.select("list", "full", F.explode("forms").alias("token"))
        .where("token not like '% %' and length(token) <= 5 and length(full) > 5 and full <> token")
        .groupBy("list", "token").agg(F.min("full").alias("full"))
    )
    return codes.union(short.join(codes.select("list", "token"), ["list", "token"], "left_anti"))


def _expanded(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``values(list, form)`` and ``long``: the form with its short words written out."""
    token = values.select("list", "form", F.posexplode(F.split("form", " ")).alias("at", "token"))
    full = token.join(dictionary, ["list", "token"], "left").withColumn("word", F.coalesce("full", "token"))
    return full.groupBy("list", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("long"))


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def map_values(values: DataFrame, catalog: DataFrame, threshold: float = 0.35, margin: float = 0.02, sure: float = 0.72) -> DataFrame:
    """``(list, value, entry_id, score)`` per distinct ``values(list, value)``.

    ``entry_id`` is 0 when no entry passes. A normalised value that equals a
    form of the list is accepted outright. Otherwise the entry with the best
    cosine must reach ``threshold`` and be ``margin`` ahead of the next entry.
    Below ``sure`` an exact check of the spelling follows, which can only
    refuse: it allows one slip and one more per six letters (a swap counts as
    one). Null, blank and bare qualifier
    values come out unmatched; ties between entries are unmatched; repeated
    values count once; an empty list leaves all values unmatched.
    """
    # values and index are used many times below, so each is computed once
    index = written(reference_index(catalog), "reference-index")
    v = values.select("list", "value").where(F.col("list").isNotNull() & F.col("value").isNotNull()).distinct()
    v = written(v.withColumn("form", _code(normalised("value"))), "values")
    forms = v.select("list", "form").where(F.length("form") > 0).distinct()
    exact = forms.join(index.select("list", "form", "entry_id"), ["list", "form"]).select("list", "form", "entry_id", F.lit(1.0).alias("score"))
    open_ = _expanded(forms.join(exact, ["list", "form"], "left_anti"), _dictionary(index))
    open_ = written(open_.where(F.length(F.replace("form", F.lit(" "), F.lit(""))) > 2), "open-values")

    entries = index.select("list", "entry_id", F.col("form").alias("entry"), F.explode(_grams(F.col("form"))).alias("gram"))
    sizes = index.groupBy("list").agg(F.count("*").alias("forms"))
    weights = entries.groupBy("list", "gram").agg(F.count_distinct("entry").alias("df")).join(sizes, "list").select("list", "gram", F.log1p(F.col("forms") / F.col("df")).alias("w"))
    posting = written(entries.join(weights, ["list", "gram"]), "postings")
    norms = posting.groupBy("list", "entry").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_norm"))

    asked = spread(open_).select("list", "form", "long", F.explode(_grams(F.col("long"))).alias("gram")).join(sizes, "list").join(weights, ["list", "gram"], "left")
    asked = asked.withColumn("w", F.coalesce("w", F.log1p("forms")))
    asked_norm = asked.groupBy("list", "form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (
        asked.select("list", "form", "long", "gram")
        .join(posting, ["list", "gram"])
        .groupBy("list", "form", "long", "entry_id", "entry")
        .agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    )
    scored = dots.join(asked_norm, ["list", "form"]).join(norms, ["list", "entry"]).withColumn("score", F.col("dot") / (F.col("norm") * F.col("entry_norm"))).where(F.col("score") >= threshold - margin)  # lower ones neither pass nor stand in the way
    a, b = F.replace("long", F.lit(" "), F.lit("")), F.replace("entry", F.lit(" "), F.lit(""))
    apart = F.levenshtein(a, b)
    slips = F.when(_letters(a) == _letters(b), F.ceil(apart / 2).cast("int")).otherwise(apart)
    scored = scored.withColumn("near", (slips <= F.when(F.length(b) < 6, 1).otherwise(1 + F.floor(F.length(b) / 6))) & (F.length(b) > 3))
    best = scored.groupBy("list", "form", "entry_id").agg(F.max("score").alias("score"), F.max("near").alias("near"))
    order = Window.partitionBy("list", "form").orderBy(F.desc("score"), "entry_id")
    first = best.withColumn("r", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("r = 1")
    clear = F.coalesce(F.col("score") - F.col("next") >= margin, F.lit(True))
    accepted = first.where((F.col("score") >= threshold) & clear & ((F.col("score") >= sure) | F.col("near"))).select("list", "form", "entry_id", "score")
    return v.join(exact.union(accepted), ["list", "form"], "left").select("list", "value", F.coalesce("entry_id", F.lit(0).cast("bigint")).alias("entry_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def typed_values(records: DataFrame, id_col: str, column: str, list_name: str) -> DataFrame:
    """``(field, record_id, list, value)`` per record with a non-blank value in ``column``."""
    r = records.select(F.lit(column).alias("field"), F.col(id_col).cast("bigint").alias("record_id"), F.lit(list_name).alias("list"), F.col(column).alias("value"))
    return r.where(F.length(F.regexp_replace("value", r"[\s\u00a0\u200b]+", "")) > 0)


def map_records(values: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(field, record_id, list, value, entry_id, score)`` per distinct row of ``typed_values``.

    The distinct values are mapped once and joined back to their records.
    """
    distinct = values.groupBy("list", "value").agg(F.count("*").alias("records"))
    mapped = written(map_values(distinct, catalog), "mapped")
    return values.distinct().join(mapped, ["list", "value"]).select("field", "record_id", "list", "value", "entry_id", "score")
