"""Joins, aggregates, windows and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import running_totals
from caseloom.operators import relational as R
from caseloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _case_key(c: str = "case_id"):
    return F.regexp_replace(F.upper(F.trim(c)), "-", "_").alias("case_key")


_CK = "regexp_replace(upper(trim({})), '-', '_', 'g')"


@query(f"""
SELECT k AS case_key, CAST(coalesce(n, 0) AS BIGINT) AS n_images
FROM (SELECT DISTINCT {_CK.format('case_id')} AS k FROM leishmaniasis_matched_cases WHERE case_id IS NOT NULL)
LEFT JOIN (SELECT {_CK.format('case_id')} AS q, sum(coalesce(len(query_images), 0)) AS n
           FROM (SELECT DISTINCT query_id, case_id, query_images FROM eval_queries) GROUP BY 1) ON q = k""")
def left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    """JN1: cases with the number of images of their queries, 0 if none."""
    cases = table(spark, d, "leishmaniasis_matched_cases").where("case_id is not null").select(_case_key()).distinct()
    images = table(spark, d, "eval_queries").select("query_id", "case_id", "query_images").distinct().select(_case_key(), F.coalesce(F.size("query_images"), F.lit(0)).alias("n"))
    return R.left_counts(cases, images, "case_key", "n_images", F.greatest(F.col("n"), F.lit(0)))


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 150000""")
def inner_join_match(spark: SparkSession, d: str) -> DataFrame:
    """JN2: inner joins with a pushed-down filter."""
    o = table(spark, d, "orders").where("o_totalprice > 150000").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT DISTINCT answer_id, model_name FROM answer_records WHERE answer_id IN
(SELECT answer_id FROM format_analyses WHERE answer_format_valid)""")
def semi_join_filter(spark: SparkSession, d: str) -> DataFrame:
    """JN3, IO11, PF12: answers that have a valid analysis."""
    valid = table(spark, d, "format_analyses").where("answer_format_valid").select("answer_id")
    return table(spark, d, "answer_records").select("answer_id", "model_name").join(valid, "answer_id", "left_semi").distinct()


@query("""SELECT case_id, 'a' AS side FROM (SELECT case_id FROM diagnosis_labels WHERE case_id IS NOT NULL EXCEPT SELECT case_id FROM eval_queries)
UNION ALL SELECT case_id, 'b' FROM (SELECT case_id FROM eval_queries WHERE case_id IS NOT NULL EXCEPT SELECT case_id FROM diagnosis_labels)""")
def anti_join_both(spark: SparkSession, d: str) -> DataFrame:
    """JN12, ST5, AG25: cases of one table only."""
    return R.difference_both(table(spark, d, "diagnosis_labels"), table(spark, d, "eval_queries"), "case_id")


@query("""SELECT case_id, count(*) AS n_queries, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS query_ids
FROM (SELECT DISTINCT query_id, case_id FROM eval_queries WHERE case_id IS NOT NULL) GROUP BY case_id""")
def nest_children(spark: SparkSession, d: str) -> DataFrame:
    """JN5: queries nested under their case."""
    q = table(spark, d, "eval_queries").where("case_id is not null").select("query_id", "case_id").distinct()
    nested = q.groupBy("case_id").agg(F.array_sort(F.collect_list("query_id")).alias("ids"))
    return nested.select("case_id", F.size("ids").cast("bigint").alias("n_queries"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("query_ids"))


@query("""WITH p AS (SELECT DISTINCT doc_id, page_index FROM page_hits WHERE doc_id IS NOT NULL AND page_index IS NOT NULL),
r AS (SELECT doc_id, page_index AS s, page_index + 2 AS e FROM p WHERE page_index % 3 <> 1)
SELECT p.doc_id, p.page_index, min(s) AS chunk_start FROM p JOIN r ON p.doc_id = r.doc_id AND page_index BETWEEN s AND e GROUP BY ALL""")
def range_join_first(spark: SparkSession, d: str) -> DataFrame:
    """JN15: each page with the first page range of its document that holds it."""
    p = table(spark, d, "page_hits").where("doc_id is not null and page_index is not null").select("doc_id", "page_index").distinct()
    r = p.where("page_index % 3 <> 1").select("doc_id", F.col("page_index").alias("chunk_start"), (F.col("page_index") + 2).alias("chunk_end"))
    return R.range_join_first(p, r, "doc_id", "page_index", "chunk_start", "chunk_end", ["chunk_start"], 8).select("doc_id", "page_index", "chunk_start")


@query("""WITH h AS (SELECT DISTINCT hit_id, doc_id, page_index FROM page_hits WHERE page_index IS NOT NULL),
g AS (SELECT DISTINCT doc_id, page_index AS g FROM page_hits WHERE micrograph_like AND page_index IS NOT NULL)
SELECT hit_id, bool_or(coalesce(abs(page_index - g) <= 1, false)) AS near_gold FROM h LEFT JOIN g USING (doc_id) GROUP BY hit_id""")
def band_match(spark: SparkSession, d: str) -> DataFrame:
    """JN16: hits at most one page away from a micrograph page, joined on three shifted keys."""
    hits = table(spark, d, "page_hits").where("page_index is not null")
    gold = hits.where("micrograph_like").select("doc_id", "page_index").distinct()
    band = gold.select("doc_id", F.explode(F.array(F.col("page_index") - 1, F.col("page_index"), F.col("page_index") + 1)).alias("page_index")).distinct().withColumn("near", F.lit(True))
    return hits.select("hit_id", "doc_id", "page_index").distinct().join(band, ["doc_id", "page_index"], "left").groupBy("hit_id").agg(F.max(F.coalesce("near", F.lit(False))).alias("near_gold"))


@query("""WITH l AS (SELECT answer_id, max(qid) AS qid, max(query_type) AS query_type FROM answer_records GROUP BY 1),
r AS (SELECT answer_id, max(rank1_diagnosis_type) AS qid, max(diagnosis_family) AS query_type FROM format_analyses GROUP BY 1)
SELECT l.answer_id, coalesce(nullif(trim(l.qid), ''), r.qid) AS qid, coalesce(nullif(trim(l.query_type), ''), r.query_type) AS query_type FROM l LEFT JOIN r USING (answer_id)""")
def prefer_nonempty(spark: SparkSession, d: str) -> DataFrame:
    """JN19, JN17: columns filled up from a second table where they are blank."""
    left = table(spark, d, "answer_records").groupBy("answer_id").agg(F.max("qid").alias("qid"), F.max("query_type").alias("query_type"))
    right = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.max("rank1_diagnosis_type").alias("qid"), F.max("diagnosis_family").alias("query_type"))
    return R.prefer_non_empty(left, right, "answer_id", ["qid", "query_type"])


@query("""WITH a AS (SELECT answer_id, max(model_name) AS m, max(top_score) AS s FROM answer_records GROUP BY 1),
b AS (SELECT answer_id, max(diagnosis_family) AS f, bool_or(answer_format_valid) AS v FROM format_analyses GROUP BY 1)
SELECT answer_id, m AS model_name, s AS top_score, f AS family, v AS valid FROM a JOIN b USING (answer_id)""")
def phase_merge(spark: SparkSession, d: str) -> DataFrame:
    """JN8: keyed merge of two phases; only keys of both stay."""
    a = table(spark, d, "answer_records").groupBy("answer_id").agg(F.max("model_name").alias("model_name"), F.max("top_score").alias("top_score"))
    b = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.max("diagnosis_family").alias("family"), F.max("answer_format_valid").alias("valid"))
    return a.join(b, "answer_id")


@query("""WITH u AS (SELECT case_id, diagnosis AS v, 0 AS s, label_id AS o FROM diagnosis_labels WHERE diagnosis IS NOT NULL AND case_id IS NOT NULL
UNION ALL SELECT case_id, ground_truth.diagnosis, 1, query_id FROM eval_queries WHERE ground_truth.diagnosis IS NOT NULL AND case_id IS NOT NULL)
SELECT case_id, v AS diagnosis, CASE s WHEN 0 THEN 'labels' ELSE 'queries' END AS from_source FROM u
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY s, o, v) = 1""")
def source_priority_merge(spark: SparkSession, d: str) -> DataFrame:
    """JN22, ST3, JN4: the first source that knows a case wins."""
    a = table(spark, d, "diagnosis_labels").where("diagnosis is not null and case_id is not null").select("case_id", "diagnosis", F.col("label_id").alias("o"))
    b = table(spark, d, "eval_queries").select("case_id", F.col("ground_truth.diagnosis").alias("diagnosis"), F.col("query_id").alias("o")).where("diagnosis is not null and case_id is not null")
    return R.merge_sources([("labels", a), ("queries", b)], "case_id", ["o", "diagnosis"]).select("case_id", "diagnosis", "from_source")


@query("""SELECT label AS label, count(*) AS members, sum(count(*)) OVER () - count(*) AS others, count(*) - 1 AS relevant_per_query FROM embeddings GROUP BY label""")
def label_qrels(spark: SparkSession, d: str) -> DataFrame:
    """JN10, EV4: how many judgements each label gives; pairs are not listed."""
    n = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("members"))
    return n.select("label", "members", (F.sum("members").over(Window.partitionBy()) - F.col("members")).alias("others"), (F.col("members") - 1).alias("relevant_per_query"))


@query("""WITH l AS (SELECT DISTINCT label_id, diagnosis AS dx, species AS sp, confirmation_method AS cm FROM diagnosis_labels WHERE diagnosis IS NOT NULL),
q AS (SELECT * FROM l), g AS (SELECT dx, sp, cm, count(*) AS n FROM l GROUP BY ALL)
SELECT label_id, CAST(sum(CASE WHEN g.sp = q.sp AND g.cm = q.cm THEN n ELSE 0 END) AS BIGINT) AS grade_3,
CAST(sum(CASE WHEN g.sp = q.sp AND NOT coalesce(g.cm = q.cm, false) THEN n ELSE 0 END) AS BIGINT) AS grade_2,
CAST(sum(CASE WHEN coalesce(g.sp = q.sp, false) THEN 0 ELSE n END) AS BIGINT) AS grade_1
FROM q JOIN g ON q.dx = g.dx GROUP BY label_id, q.sp, q.cm""")
def entity_grade_qrels(spark: SparkSession, d: str) -> DataFrame:
    """JN7, EV1, EV3: graded relevance of every label against all, once per entity group and joined back."""
    rows = table(spark, d, "diagnosis_labels").where("diagnosis is not null").select("label_id", F.col("diagnosis").alias("dx"), F.col("species").alias("sp"), F.col("confirmation_method").alias("cm")).distinct()
    groups = rows.groupBy("dx", F.col("sp").alias("g_sp"), F.col("cm").alias("g_cm")).agg(F.count("*").alias("n"))
    both = groups.select("dx", F.col("g_sp").alias("sp"), F.col("g_cm").alias("cm")).join(groups, "dx")
    same, confirmed = F.coalesce(F.col("sp") == F.col("g_sp"), F.lit(False)), F.coalesce(F.col("cm") == F.col("g_cm"), F.lit(False))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    grades = both.groupBy("dx", "sp", "cm").agg(n(same & confirmed).alias("grade_3"), n(same & ~confirmed).alias("grade_2"), n(~same).alias("grade_1"))
    g = grades.select(F.col("dx").alias("g_dx"), F.col("sp").alias("g_sp"), F.col("cm").alias("g_cm"), "grade_3", "grade_2", "grade_1")
    of_label = (F.col("dx") == F.col("g_dx")) & F.col("sp").eqNullSafe(F.col("g_sp")) & F.col("cm").eqNullSafe(F.col("g_cm"))
    return rows.join(g, of_label).select("label_id", "grade_3", "grade_2", "grade_1")


@query("""SELECT count(*) AS documents, count_if(lower(text) LIKE '%leishmania%') AS mentions, count_if(lang IS NULL) AS no_language,
count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents""")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """AG1, AG3, PF3: one row of counts under conditions."""
    x = table(spark, d, "documents")
    return x.agg(
        F.count("*").alias("documents"), F.count_if(F.lower("text").contains("leishmania")).alias("mentions"), F.count_if(F.col("lang").isNull()).alias("no_language"),
        F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("characters"),
    )


@query("SELECT coalesce(nullif(trim(query_type), ''), 'MISSING') AS query_type, count(*) AS n FROM answer_records GROUP BY 1")
def missing_bucket(spark: SparkSession, d: str) -> DataFrame:
    """AG2, AG12: counts with a bucket for what is missing."""
    return table(spark, d, "answer_records").groupBy(F.coalesce(F.nullif(F.trim("query_type"), F.lit("")), F.lit("MISSING")).alias("query_type")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count_if(value < 5) AS low, count_if(value >= 5 AND value < 15) AS mid, count_if(value >= 15) AS high FROM events GROUP BY event_type""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """AG4: cross-tabulation with known columns, so one pass."""
    x = table(spark, d, "events").withColumn("level", F.when(F.col("value") < 5, "low").when(F.col("value") < 15, "mid").otherwise("high"))
    return x.groupBy("event_type").pivot("level", ["low", "mid", "high"]).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT coalesce(lower(trim(source)), '') AS source, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, min(length(text)) AS min_chars,
max(length(text)) AS max_chars, round(median(length(text)), 6) AS median_chars, round(sum(length(text)) / 1024.0, 6) AS kb FROM documents GROUP BY 1""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG5, EV45: lengths of texts by source."""
    n = F.length("text")
    return table(spark, d, "documents").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")).agg(
        F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).cast("bigint").alias("min_chars"), F.max(n).cast("bigint").alias("max_chars"),
        F.round(F.median(n), 6).alias("median_chars"), F.round(F.sum(n) / 1024.0, 6).alias("kb"),
    )


@query("""SELECT count(*) AS queries, count_if(len(query_images) > 0) AS with_images, CAST(sum(coalesce(len(query_images), 0)) AS BIGINT) AS images,
round(avg(len(query_images)), 6) AS mean_images FROM (SELECT DISTINCT query_id, query_images FROM eval_queries)""")
def nested_totals(spark: SparkSession, d: str) -> DataFrame:
    """AG6, PF25: totals over nested arrays."""
    n = F.when(F.col("query_images").isNotNull(), F.size("query_images"))
    return table(spark, d, "eval_queries").select("query_id", "query_images").distinct().agg(
        F.count("*").alias("queries"), F.count_if(n > 0).alias("with_images"), F.sum(F.coalesce(n, F.lit(0))).alias("images"), F.round(F.avg(n), 6).alias("mean_images")
    )


@query("""SELECT coalesce(bucket, 'all') AS bucket, n, round(valid, 6) AS valid_rate FROM (
SELECT CASE WHEN lower(rank1_diagnosis_type) LIKE 'non%' THEN 'nonleish' ELSE 'leish' END AS bucket, count(*) AS n, avg(CAST(answer_format_valid AS INT)) AS valid
FROM format_analyses GROUP BY GROUPING SETS ((bucket), ()))""")
def bucket_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AG10: rates by bucket and over all, in one grouping-set pass."""
    x = table(spark, d, "format_analyses").withColumn("bucket", F.when(F.lower("rank1_diagnosis_type").like("non%"), "nonleish").otherwise("leish"))
    r = x.rollup("bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.col("answer_format_valid").cast("int")), 6).alias("valid_rate"))
    return r.select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "n", "valid_rate")


@query("""SELECT tier, count(*) AS n, round(avg(top_score), 6) AS mean_score FROM (
SELECT top_score, unnest(CASE t WHEN 'C' THEN ['C'] ELSE [t, 'A+B'] END) AS tier FROM (
SELECT top_score, CASE WHEN top_score >= 0.7 THEN 'A' WHEN top_score >= 0.4 THEN 'B' ELSE 'C' END AS t FROM answer_records WHERE top_score IS NOT NULL)) GROUP BY tier""")
def tier_overlap(spark: SparkSession, d: str) -> DataFrame:
    """AG15, AG16, PF11: a row counts in its tier and in the joint one."""
    s = F.col("top_score")
    x = table(spark, d, "answer_records").where(s.isNotNull()).select("top_score", F.when(s >= 0.7, "A").when(s >= 0.4, "B").otherwise("C").alias("t"))
    x = x.select("top_score", F.explode(F.when(F.col("t") == "C", F.array("t")).otherwise(F.array("t", F.lit("A+B")))).alias("tier"))
    return x.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("top_score"), 6).alias("mean_score"))


@query("""SELECT coalesce(generation_mode, '-') AS mode, grouping(generation_mode) AS all_modes, coalesce(retrieval_support_status, '-') AS status,
grouping(retrieval_support_status) AS all_statuses, count(*) AS n FROM answer_records GROUP BY CUBE (generation_mode, retrieval_support_status)""")
def mode_bucket_cube(spark: SparkSession, d: str) -> DataFrame:
    """AG17: counts by mode and status with all margins."""
    c = table(spark, d, "answer_records").cube("generation_mode", "retrieval_support_status").agg(
        F.count("*").alias("n"), F.grouping("generation_mode").cast("bigint").alias("all_modes"), F.grouping("retrieval_support_status").cast("bigint").alias("all_statuses")
    )
    return c.select(F.coalesce("generation_mode", F.lit("-")).alias("mode"), "all_modes", F.coalesce("retrieval_support_status", F.lit("-")).alias("status"), "all_statuses", "n")


_HIST = """WITH h AS (SELECT CAST(least(9, floor(top_score * 10)) AS INT) AS bin, count(*) AS n, avg(CAST(coalesce(answer_format_valid, false) AS INT)) AS valid
FROM answer_records WHERE top_score IS NOT NULL GROUP BY 1) """


@query(_HIST + "SELECT bin, n, round(valid, 6) AS valid_rate FROM h")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG19: half-open bins of a score with a rate."""
    x = table(spark, d, "answer_records").where("top_score is not null")
    b = F.least(F.lit(9), F.floor(F.col("top_score") * 10)).cast("int")
    return x.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("answer_format_valid", F.lit(False)).cast("int")), 6).alias("valid_rate"))


@query(_HIST + "SELECT min(bin) AS bin FROM h WHERE valid > (SELECT avg(CAST(coalesce(answer_format_valid, false) AS INT)) FROM answer_records WHERE top_score IS NOT NULL) AND n >= 3")
def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    """AG20: the first bin that does better than the mean."""
    x = table(spark, d, "answer_records").where("top_score is not null").select(F.least(F.lit(9), F.floor(F.col("top_score") * 10)).cast("int").alias("bin"), F.coalesce("answer_format_valid", F.lit(False)).cast("int").alias("v"))
    h = x.groupBy("bin").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    w = Window.partitionBy()  # ten rows
    return h.withColumn("mean", F.sum("s").over(w) / F.sum("n").over(w)).where("n >= 3 and s / n > mean").agg(F.min("bin").alias("bin"))


@query("""WITH s AS (SELECT question_id, count(DISTINCT hit_id) AS n FROM page_hits WHERE question_id IS NOT NULL GROUP BY 1)
SELECT min(n) AS lo, max(n) AS hi, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_pop(n), 6) AS sd FROM s""")
def list_size_stats(spark: SparkSession, d: str) -> DataFrame:
    """AG21: sizes of ranked lists."""
    s = table(spark, d, "page_hits").where("question_id is not null").groupBy("question_id").agg(F.count_distinct("hit_id").alias("n"))
    return s.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n"), 6).alias("median"), F.round(F.stddev_pop("n"), 6).alias("sd"))


@query("""SELECT answer_id, count(*) AS copies, count(DISTINCT ingested_at) AS arrivals FROM answer_records GROUP BY 1 HAVING count(*) > 1""")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    """IO8: keys that occur repeatedly."""
    return table(spark, d, "answer_records").groupBy("answer_id").agg(F.count("*").alias("copies"), F.count_distinct("ingested_at").alias("arrivals")).where("copies > 1")


@query("""WITH c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(keywords) AS k FROM page_hits) GROUP BY 1)
SELECT count(*) AS docs, round(avg(n), 6) AS mean, min(n) AS lo, max(n) AS hi FROM c""")
def density(spark: SparkSession, d: str) -> DataFrame:
    """AG26: keywords per document, in two levels."""
    c = table(spark, d, "page_hits").select("doc_id", F.explode("keywords").alias("k")).groupBy("doc_id").agg(F.count_distinct("k").alias("n"))
    return c.agg(F.count("*").alias("docs"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("lo"), F.max("n").alias("hi"))


@query("""WITH m AS (SELECT coalesce(model_name, '') AS model, avg(top_score) AS s FROM answer_records GROUP BY 1)
SELECT max_by(model, s) AS best, round(max(s), 6) AS top, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS sd FROM m""")
def best_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """AG31, AG28: best model with mean and sample deviation of the models."""
    m = table(spark, d, "answer_records").groupBy(F.coalesce("model_name", F.lit("")).alias("model")).agg(F.avg("top_score").alias("s"))
    return m.agg(F.max_by("model", "s").alias("best"), F.round(F.max("s"), 6).alias("top"), F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_samp("s"), 6).alias("sd"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS lo, max(value) AS hi,
round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    """AG32, AG42: exact summary by group."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        *[F.round(F.percentile(v, q), 6).alias(a) for q, a in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))],
    )


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS price, round(corr(l_quantity, l_discount), 6) AS discount, round(corr(l_extendedprice, l_tax), 6) AS tax FROM lineitem""")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    """AG33: correlations in one pass."""
    c = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return table(spark, d, "lineitem").agg(c("l_quantity", "l_extendedprice", "price"), c("l_quantity", "l_discount", "discount"), c("l_extendedprice", "l_tax", "tax"))


def _average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values with their average rank; only distinct values are ordered, in ranges."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    return running_totals(n, [value], F.col("n")).select(value, (F.col("ahead") + (F.col("n") + 1) / 2).alias(name))


@query("""WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity)) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
(rank() OVER (ORDER BY l_discount)) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    """AG34: rank correlation; ranks come from value counts, so no row is sorted with all others."""
    x = table(spark, d, "lineitem").select("l_quantity", "l_discount")
    r = x.join(_average_rank(x, "l_quantity", "a"), "l_quantity").join(_average_rank(x, "l_discount", "b"), "l_discount")
    return r.agg(F.round(F.corr("a", "b"), 6).alias("rho"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount + l_tax) / 2, 6) AS mean,
round(((l_discount - (l_discount + l_tax) / 2) ** 2 + (l_tax - (l_discount + l_tax) / 2) ** 2) / 2, 6) AS var FROM lineitem""")
def row_mean_variance(spark: SparkSession, d: str) -> DataFrame:
    """AG35, AG49: mean and variance across columns of a row."""
    a, b = F.col("l_discount"), F.col("l_tax")
    m = (a + b) / 2
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(m, 6).alias("mean"), F.round((F.pow(a - m, F.lit(2)) + F.pow(b - m, F.lit(2))) / 2, 6).alias("var"))


@query("""WITH v AS (SELECT doc_id, count(DISTINCT hit_id) FILTER (page_kind = 'mixed') AS mixed, count(DISTINCT hit_id) FILTER (page_kind = 'mostly_text') AS txt, count(DISTINCT hit_id) AS n FROM page_hits GROUP BY 1)
SELECT doc_id, CASE WHEN mixed * 2 > n THEN 'mixed' WHEN txt * 2 > n THEN 'mostly_text' ELSE 'undecided' END AS kind FROM v""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """AG36: the kind that most hits of a document have, if strictly most."""
    h = table(spark, d, "page_hits").select("doc_id", "hit_id", "page_kind").distinct()
    v = h.groupBy("doc_id").agg(F.count_if(F.col("page_kind") == "mixed").alias("mixed"), F.count_if(F.col("page_kind") == "mostly_text").alias("txt"), F.count("*").alias("n"))
    return v.select("doc_id", F.when(F.col("mixed") * 2 > F.col("n"), "mixed").when(F.col("txt") * 2 > F.col("n"), "mostly_text").otherwise("undecided").alias("kind"))


@query("""SELECT coalesce(via, '') AS via, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM page_hits WHERE rank <= 5 GROUP BY 1""")
def modality_share(spark: SparkSession, d: str) -> DataFrame:
    """AG41: shares of the lanes among the first five."""
    n = table(spark, d, "page_hits").where("rank <= 5").groupBy(F.coalesce("via", F.lit("")).alias("via")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""SELECT label, i AS pos, round(avg(embedding[i]), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY ALL""")
def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    """AG44: mean vector by label, position by position."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return x.groupBy("label", (F.col("p") + 1).cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""WITH a AS (SELECT answer_id, bool_or(coalesce(answer_format_valid, false)) AS v FROM answer_records GROUP BY 1),
b AS (SELECT answer_id, bool_or(coalesce(answer_format_valid, false)) AS v FROM format_analyses GROUP BY 1)
SELECT count_if(a.v AND b.v) AS both_right, count_if(NOT a.v AND NOT b.v) AS both_wrong, count_if(a.v AND NOT b.v) AS only_a, count_if(NOT a.v AND b.v) AS only_b FROM a JOIN b USING (answer_id)""")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    """AG48, EV38: two judgements against each other."""
    v = lambda t, n: table(spark, d, t).groupBy("answer_id").agg(F.max(F.coalesce("answer_format_valid", F.lit(False))).alias(n))
    a, b = F.col("a"), F.col("b")
    return v("answer_records", "a").join(v("format_analyses", "b"), "answer_id").agg(F.count_if(a & b).alias("both_right"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))


@query("""SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events""")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    """WN3: best value so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.max("value").over(w).alias("best"))


_KEEP = "SELECT case_id, label_id, confidence FROM (SELECT DISTINCT case_id, label_id, confidence FROM diagnosis_labels) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {}) = 1"


@query(_KEEP.format("label_id, confidence NULLS FIRST"))
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """WN4: the first row of a key stays."""
    x = table(spark, d, "diagnosis_labels").select("case_id", "label_id", "confidence").distinct()
    return R.keep_first(x, ["case_id"], [F.col("label_id"), F.col("confidence").asc_nulls_first()])


@query(_KEEP.format("label_id DESC, confidence DESC NULLS LAST"))
def dedup_last(spark: SparkSession, d: str) -> DataFrame:
    """WN5, WN6: the last row of a key stays."""
    x = table(spark, d, "diagnosis_labels").select("case_id", "label_id", "confidence").distinct()
    return R.keep_first(x, ["case_id"], [F.desc("label_id"), F.col("confidence").desc_nulls_last()])


@query("""SELECT case_id, label_id, confidence FROM (SELECT DISTINCT case_id, label_id, confidence, error FROM diagnosis_labels)
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY (CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END), (error IS NOT NULL), label_id DESC, confidence NULLS FIRST) = 1""")
def priority_dedup(spark: SparkSession, d: str) -> DataFrame:
    """WN7, WN8, SM3: the best row of a key stays, the newest of the best."""
    x = table(spark, d, "diagnosis_labels").select("case_id", "label_id", "confidence", "error").distinct()
    order = [F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2), F.col("error").isNotNull(), F.desc("label_id"), F.col("confidence").asc_nulls_first()]
    return R.keep_first(x, ["case_id"], order).drop("error")


@query("""WITH s AS (SELECT DISTINCT doc_id, page_index AS s, page_index + coalesce(rank, 1) % 3 AS e FROM page_hits WHERE page_index IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 2) + 1 THEN 1 ELSE 0 END AS nw FROM s),
g AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, g.g""")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """WN24: touching page ranges joined."""
    x = table(spark, d, "page_hits").where("page_index is not null and doc_id is not null").select("doc_id", F.col("page_index").alias("s"), (F.col("page_index") + F.coalesce("rank", F.lit(1)) % 3).alias("e")).distinct()
    return R.interval_merge(x, "doc_id", "s", "e")


@query("SELECT case_id FROM diagnosis_labels UNION SELECT case_id FROM eval_queries UNION SELECT case_id FROM leishmaniasis_matched_cases")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """ST1, ST2: union of keys without repeats."""
    a, b, c = (table(spark, d, t).select("case_id") for t in ("diagnosis_labels", "eval_queries", "leishmaniasis_matched_cases"))
    return a.union(b).union(c).distinct()


@query("SELECT case_id FROM diagnosis_labels INTERSECT SELECT case_id FROM eval_queries")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    """ST4: keys of both."""
    return table(spark, d, "diagnosis_labels").select("case_id").intersect(table(spark, d, "eval_queries").select("case_id"))


@query("""SELECT coalesce(split, '') AS split, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) FILTER (case_id IN (SELECT case_id FROM eval_queries WHERE split = 'train')) AS also_in_train
FROM eval_queries GROUP BY 1""")
def disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Cases of each split that are in train as well."""
    q = table(spark, d, "eval_queries").select(F.coalesce("split", F.lit("")).alias("split"), "case_id").distinct()
    train = q.where("split = 'train' and case_id is not null").select("case_id").distinct().withColumn("t", F.lit(1))
    return q.join(train, "case_id", "left").groupBy("split").agg(F.count("case_id").alias("cases"), F.count("t").alias("also_in_train"))


@query("""SELECT query_id, CAST(len(list_intersect(regexp_split_to_array(lower(question), '[^a-z]+'), ['diagnosis', 'rank', 'reasons'])) AS INT) AS common, question LIKE '%three%' AS three FROM eval_queries""")
def array_overlap(spark: SparkSession, d: str) -> DataFrame:
    """ST6, ST8: intersections of arrays in a row."""
    words = F.split(F.lower("question"), "[^a-z]+")
    want = F.array(F.lit("diagnosis"), F.lit("rank"), F.lit("reasons"))
    return table(spark, d, "eval_queries").select("query_id", F.size(F.array_intersect(words, want)).alias("common"), F.col("question").contains("three").alias("three"))


@query("""WITH t AS (SELECT DISTINCT answer_id, query, answer FROM answer_records WHERE answer IS NOT NULL AND query IS NOT NULL),
a AS (SELECT answer_id, w, count(*) AS n FROM (SELECT answer_id, unnest(regexp_split_to_array(lower(answer), '[^a-z0-9]+')) AS w FROM t) WHERE w <> '' GROUP BY ALL),
b AS (SELECT answer_id, w, count(*) AS n FROM (SELECT answer_id, unnest(regexp_split_to_array(lower(query), '[^a-z0-9]+')) AS w FROM t) WHERE w <> '' GROUP BY ALL),
c AS (SELECT a.answer_id, sum(least(a.n, b.n)) AS m FROM a JOIN b USING (answer_id, w) GROUP BY 1),
sa AS (SELECT answer_id, sum(n) AS s FROM a GROUP BY 1), sb AS (SELECT answer_id, sum(n) AS s FROM b GROUP BY 1)
SELECT answer_id, CAST(m AS BIGINT) AS common, round(2.0 * m / (sa.s + sb.s), 6) AS f1 FROM c JOIN sa USING (answer_id) JOIN sb USING (answer_id)""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """ST7, SC55: multiset overlap of answer and query by term counts."""
    t = table(spark, d, "answer_records").where("answer is not null and query is not null").select("answer_id", "query", "answer").distinct()

    def counts(c: str, n: str) -> DataFrame:
        return t.select("answer_id", F.explode(F.split(F.lower(c), "[^a-z0-9]+")).alias("w")).where("w <> ''").groupBy("answer_id", "w").agg(F.count("*").alias(n))

    both = counts("answer", "n").join(counts("query", "m"), ["answer_id", "w"], "full")
    s = both.groupBy("answer_id").agg(F.sum(F.least("n", "m")).alias("_"), F.sum(F.when(F.col("n").isNotNull() & F.col("m").isNotNull(), F.least("n", "m"))).alias("common"), F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("all"))
    return s.where("common is not null").select("answer_id", "common", F.round(2.0 * F.col("common") / F.col("all"), 6).alias("f1"))


@query("""SELECT n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Extra: star join and aggregate; keys are summed before the small joins."""
    line = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(spark, d, "orders").where("o_orderstatus is not null").select("o_orderkey", "o_custkey")
    per = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    x = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("n_name").agg(F.sum("n").alias("orders"), F.round(F.sum("r"), 2).alias("revenue"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    """Extra: daily windows."""
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day")["start"].alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s""")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    """Extra: sessions parted by six quiet hours."""
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")
