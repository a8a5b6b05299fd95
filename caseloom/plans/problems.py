"""Registered queries of the general data-set problems (3, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import canonical, grouped_split, overlap
from caseloom.sources.tables import table


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "diagnosis_catalog")
    analyses, labels = table(spark, sf_dir, "format_analyses"), table(spark, sf_dir, "diagnosis_labels")
    values = canonical.typed_values(analyses, "answer_id", "rank1_diagnosis_text", "diagnosis")
    values = values.union(canonical.typed_values(analyses, "answer_id", "diagnosis_family", "family"))
    values = values.union(canonical.typed_values(labels, "label_id", "diagnosis_type", "type"))
    return canonical.map_records(values, catalog)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "diagnosis_catalog").select(F.col("list_name").alias("list"), F.col("canonical_name").alias("value")).distinct()
    return _mapped(spark, sf_dir).join(names, ["list", "value"], "left_anti").select("field", "record_id", "entry_id").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched values and how many records hold them."""
    return _mapped(spark, sf_dir).where("entry_id = 0").groupBy("field", "value").agg(F.count_distinct("record_id").alias("records"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = table(spark, sf_dir, "leishmaniasis_matched_cases")
    return records, grouped_split.grouped_split(records)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the split keeps together; the split itself is ``p4_split``."""
    records = table(spark, sf_dir, "leishmaniasis_matched_cases").select("row_id", "article_id", "case_id").distinct()
    return grouped_split.record_groups(records).select("row_id", "group_article").distinct()


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1].select("row_id", "split")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, assigned = _split(spark, sf_dir)
    return grouped_split.split_report(assigned, records)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, sf_dir, "eval_queries"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "eval_queries"), table(spark, sf_dir, "leishmaniasis_matched_cases"))


QUERIES = {f.__name__: f for f in (p3_found, p3_unmatched, p4_found, p4_split, p4_report, p5_found, p5_report)}

_ARTICLE = r"regexp_extract(lower({}), '^\s*(?:pmcid)?[\s:]*(?:pmc)?[\s:_\-]*0*([1-9][0-9]{{0,8}})(?:\.[0-9]+)?\s*$', 1)"
_CASE = r"regexp_extract(lower({}), '^\s*(?:pmcid)?[\s:]*(?:pmc)?[\s:\-]*0*([1-9][0-9]{{0,8}})\s*[_\-][^_]*$', 1)"

SQL = {
    "p4_found": f"""
WITH RECURSIVE r AS (
  SELECT DISTINCT row_id, nullif({_ARTICLE.format("article_id")}, '') AS a, nullif({_CASE.format("case_id")}, '') AS c
  FROM leishmaniasis_matched_cases),
n AS (SELECT row_id, 'PMC' || lpad(a, 9, '0') AS a, 'PMC' || lpad(c, 9, '0') AS c FROM r),
e AS (SELECT DISTINCT a AS u, c AS v FROM n WHERE a <> c UNION SELECT DISTINCT c, a FROM n WHERE a <> c),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
root AS (SELECT u, least(u, min(v)) AS g FROM reach GROUP BY u)
SELECT DISTINCT row_id, coalesce(g, coalesce(c, a)) AS group_article
FROM n LEFT JOIN root ON root.u = coalesce(n.c, n.a)
""",
    "p5_found": r"""
WITH q AS (
  SELECT DISTINCT query_id, lower(trim(split)) = 'train' AS tr,
         list_distinct(list_filter(regexp_split_to_array(lower(clinical_context), '[^\p{L}\p{N}\p{M}]+'), lambda w: w <> '')) AS ws
  FROM eval_queries
  WHERE clinical_context IS NOT NULL AND lower(trim(split)) IN ('train', 'validation', 'test')),
k AS (SELECT query_id, tr, len(ws) AS n, unnest(ws) AS w FROM q WHERE len(ws) >= 12)
SELECT DISTINCT least(a.query_id, b.query_id) AS query_id_a, greatest(a.query_id, b.query_id) AS query_id_b
FROM k a JOIN k b ON a.w = b.w AND a.tr AND NOT b.tr
WHERE a.query_id <> b.query_id
GROUP BY a.query_id, b.query_id, a.n, b.n
HAVING 4 * count(DISTINCT a.w) >= 3 * (a.n + b.n - count(DISTINCT a.w))
""",
}
