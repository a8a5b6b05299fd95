"""Comparisons, audits, selections and further text rules over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import entities as N
from caseloom.operators import ranking as K
from caseloom.operators import retrieval as S
from caseloom.operators.relational import keep_first
from caseloom.plans import lists as L
from caseloom.session import written
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


@query("""WITH h AS (SELECT DISTINCT question_id, hit_id, page_kind = 'mixed' AND via = 'dense' AS strict FROM page_hits WHERE question_id IS NOT NULL),
s AS (SELECT DISTINCT question_id FROM h WHERE strict) SELECT question_id, hit_id FROM h WHERE strict OR question_id NOT IN (SELECT question_id FROM s)""")
def filter_relaxation(spark: SparkSession, d: str) -> DataFrame:
    """PF15: strict hits, and for questions without any, all hits."""
    h = table(spark, d, "page_hits").where("question_id is not null").select("question_id", "hit_id", F.coalesce((F.col("page_kind") == "mixed") & (F.col("via") == "dense"), F.lit(False)).alias("strict")).distinct()
    any_strict = F.max("strict").over(Window.partitionBy("question_id"))
    return h.withColumn("any", any_strict).where("strict or not any").select("question_id", "hit_id").distinct()


@query("""WITH t AS (SELECT event_type, quantile_cont(value, 0.15) AS t FROM events GROUP BY 1)
SELECT event_type, count_if(value >= t) AS kept, count_if(value < t) AS dropped FROM events JOIN t USING (event_type) GROUP BY 1""")
def keep_drop_split(spark: SparkSession, d: str) -> DataFrame:
    """PF18, AG42: kept and dropped rows under a threshold of each label."""
    e = table(spark, d, "events").select("event_type", "value")
    t = e.groupBy("event_type").agg(F.percentile("value", 0.15).alias("t"))
    return e.join(t, "event_type").groupBy("event_type").agg(F.count_if(F.col("value") >= F.col("t")).alias("kept"), F.count_if(F.col("value") < F.col("t")).alias("dropped"))


@query("""SELECT DISTINCT answer_id, len(list_filter(prompt_context_doc_ids, lambda c: c <> split_part(qid, '::', 1))) AS others,
coalesce(list_position(prompt_context_doc_ids, split_part(qid, '::', 1)), 0) AS own_rank FROM answer_records WHERE qid IS NOT NULL AND prompt_context_doc_ids IS NOT NULL""")
def context_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF19, JN24, WN21: contexts of other cases, and at which rank the own case stands."""
    own = F.split("qid", "::")[0]
    a = table(spark, d, "answer_records").where("qid is not null and prompt_context_doc_ids is not null").withColumn("own", own)
    return a.select("answer_id", F.size(F.filter("prompt_context_doc_ids", lambda c: c != F.col("own"))).cast("bigint").alias("others"), F.array_position("prompt_context_doc_ids", F.col("own")).alias("own_rank")).distinct()


@query(r"""WITH v AS (SELECT diagnosis AS v, count(*) AS n FROM diagnosis_labels WHERE diagnosis IS NOT NULL GROUP BY 1), c AS (SELECT entry_id, canonical_name AS c FROM diagnosis_catalog WHERE list_name = 'diagnosis'),
m AS (SELECT v, n, entry_id, 1 AS tier FROM v JOIN c ON v = c UNION ALL SELECT v, n, entry_id, 2 FROM v JOIN c ON lower(trim(v)) = lower(c)
UNION ALL SELECT v, n, entry_id, 3 FROM v JOIN c ON regexp_replace(lower(v), '[^a-z]', '', 'g') = regexp_replace(lower(c), '[^a-z]', '', 'g'))
SELECT v AS value, n AS records, entry_id, tier FROM m QUALIFY row_number() OVER (PARTITION BY v ORDER BY tier, entry_id) = 1""")
def tiered_keys(spark: SparkSession, d: str) -> DataFrame:
    """SC30: keys resolved exactly, else folded, else by letters only."""
    v = table(spark, d, "diagnosis_labels").where("diagnosis is not null").groupBy(F.col("diagnosis").alias("value")).agg(F.count("*").alias("records"))
    c = table(spark, d, "diagnosis_catalog").where("list_name = 'diagnosis'").select("entry_id", F.col("canonical_name").alias("c"))
    forms = [lambda x: x, lambda x: F.lower(F.trim(x)), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", "")]
    long = lambda df, x: df.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("tier"), f(F.col(x)).alias("form")) for i, f in enumerate(forms)]))).select("*", "k.tier", "k.form").drop("k")
    hit = long(v, "value").join(long(c, "c"), ["tier", "form"])
    return keep_first(hit, ["value"], [F.col("tier"), F.col("entry_id")]).select("value", "records", "entry_id", "tier")


@query("""WITH a AS (SELECT DISTINCT answer_id FROM answer_records), p AS (SELECT answer_id, count(*) AS n FROM format_analyses GROUP BY 1)
SELECT count_if(p.answer_id IS NULL) AS missing, count_if(a.answer_id IS NULL) AS extra, count_if(p.n > 1) AS repeated, count(*) AS keys FROM a FULL JOIN p USING (answer_id)""")
def merge_check(spark: SparkSession, d: str) -> DataFrame:
    """JN21, IO9, EV42, EV46: whether parts cover their source exactly."""
    a = table(spark, d, "answer_records").select("answer_id").distinct().withColumn("a", F.lit(1))
    p = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.count("*").alias("n"))
    return a.join(p, "answer_id", "full").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"), F.count("*").alias("keys"))


@query("""WITH c AS (SELECT case_id, max(diagnosis) AS dx FROM diagnosis_labels WHERE case_id IS NOT NULL GROUP BY 1),
x AS (SELECT answer_id, unnest(ids) AS case_id FROM (SELECT answer_id, max(prompt_context_doc_ids) AS ids FROM answer_records GROUP BY 1)),
n AS (SELECT answer_id, coalesce(dx, 'unknown') AS dx, count(*) AS n FROM x LEFT JOIN c USING (case_id) GROUP BY ALL)
SELECT answer_id, CAST(sum(n) AS BIGINT) AS contexts, count(*) AS labels, max(n) * 2 > sum(n) AS dominated FROM n GROUP BY answer_id""")
def label_dominance(spark: SparkSession, d: str) -> DataFrame:
    """JN23: labels of the contexts of an answer and whether one dominates."""
    c = table(spark, d, "diagnosis_labels").where("case_id is not null").groupBy("case_id").agg(F.max("diagnosis").alias("dx"))
    x = table(spark, d, "answer_records").groupBy("answer_id").agg(F.max("prompt_context_doc_ids").alias("ids")).select("answer_id", F.explode("ids").alias("case_id"))
    n = x.join(c, "case_id", "left").groupBy("answer_id", F.coalesce("dx", F.lit("unknown")).alias("dx")).agg(F.count("*").alias("n"))
    return n.groupBy("answer_id").agg(F.sum("n").alias("contexts"), F.count("*").alias("labels"), (F.max("n") * 2 > F.sum("n")).alias("dominated"))


@query("""WITH c AS (SELECT type_code, min(canonical_name) AS c FROM diagnosis_catalog WHERE list_name = 'diagnosis' AND type_code <> 'Non-Leishmaniasis' GROUP BY 1),
f AS (SELECT answer_id, max(lower(trim(rank1_diagnosis_text))) AS t, max(rank1_diagnosis_type) AS type_code FROM format_analyses GROUP BY 1)
SELECT answer_id, CASE WHEN t = lower(c) THEN 1.0 WHEN contains(t, lower(c)) OR (length(t) > 0 AND contains(lower(c), t)) THEN 0.5 ELSE 0.0 END::DOUBLE AS accuracy FROM f JOIN c USING (type_code) WHERE t IS NOT NULL""")
def containment_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """JN25, SC58: 1 for equal names, a half where one holds the other."""
    c = table(spark, d, "diagnosis_catalog").where("list_name = 'diagnosis' and type_code <> 'Non-Leishmaniasis'").groupBy("type_code").agg(F.lower(F.min("canonical_name")).alias("c"))
    f = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.max(F.lower(F.trim("rank1_diagnosis_text"))).alias("t"), F.max("rank1_diagnosis_type").alias("type_code")).where("t is not null")
    t, n = F.col("t"), F.col("c")
    return f.join(c, "type_code").select("answer_id", F.when(t == n, 1.0).when(F.contains(t, n) | ((F.length(t) > 0) & F.contains(n, t)), 0.5).otherwise(0.0).alias("accuracy"))


@query("""WITH w AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(regexp_split_to_array(lower(clinical_context), '[^a-z]+')) AS w FROM eval_queries) WHERE length(w) > 3),
c AS (SELECT DISTINCT entry_id, w FROM (SELECT entry_id, unnest(regexp_split_to_array(lower(canonical_name || ' ' || coalesce(array_to_string(aliases, ' '), '')), '[^a-z]+')) AS w FROM diagnosis_catalog) WHERE length(w) > 3)
SELECT query_id, entry_id, count(*) AS common FROM w JOIN c USING (w) GROUP BY ALL HAVING count(*) >= 2""")
def shared_words(spark: SparkSession, d: str) -> DataFrame:
    """JN28: pairs of queries and catalogue entries that share two words or more, by an equi-join on words."""
    words = lambda df, i, c: df.select(i, F.explode(F.split(F.lower(c), "[^a-z]+")).alias("w")).where("length(w) > 3").distinct()
    q = words(table(spark, d, "eval_queries"), "query_id", F.col("clinical_context"))
    c = words(table(spark, d, "diagnosis_catalog"), "entry_id", F.concat_ws(" ", "canonical_name", F.coalesce(F.array_join("aliases", " "), F.lit(""))))
    return q.join(F.broadcast(c), "w").groupBy("query_id", "entry_id").agg(F.count("*").alias("common")).where("common >= 2")  # a fixed table of 56 rows


@query("""SELECT coalesce(split_part(qid, '::', 1), '') AS case_id, count(DISTINCT answer_id) AS answers, round(avg(CASE WHEN top_score >= 0.2 THEN top_score END), 9) AS mean_score,
round(avg(CAST(answer_format_valid AS INT)), 6) AS success, round(count(top_score) / count(*), 6) AS coverage FROM answer_records GROUP BY 1""")
def case_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG11: rates and coverage per case, leaving out marked values."""
    s = F.col("top_score")
    return table(spark, d, "answer_records").groupBy(F.coalesce(F.split("qid", "::")[0], F.lit("")).alias("case_id")).agg(
        F.count_distinct("answer_id").alias("answers"), F.round(F.avg(F.when(s >= 0.2, s)), 9).alias("mean_score"), F.round(F.avg(F.col("answer_format_valid").cast("int")), 6).alias("success"), F.round(F.count(s) / F.count("*"), 6).alias("coverage"),
    )


@query("""SELECT regexp_extract(image_path, '([^/.]+)[^/]*$', 1) = '' AS no_name, regexp_extract(image_path, '\\.([a-z]+)$', 1) AS kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM page_hits WHERE image_path IS NOT NULL GROUP BY ALL""")
def file_categories(spark: SparkSession, d: str) -> DataFrame:
    """AG40, SC48, SC56: kinds of files by their path."""
    p = "image_path"
    return table(spark, d, "page_hits").where(F.col(p).isNotNull()).groupBy((F.regexp_extract(p, r"([^/.]+)[^/]*$", 1) == "").alias("no_name"), F.regexp_extract(p, r"\.([a-z]+)$", 1).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""(SELECT DISTINCT 'best' AS side, answer_id, top_score FROM answer_records WHERE top_score IS NOT NULL ORDER BY top_score DESC, answer_id LIMIT 10)
UNION ALL (SELECT DISTINCT 'worst', answer_id, top_score FROM answer_records WHERE top_score IS NOT NULL ORDER BY top_score, answer_id LIMIT 10)""")
def best_worst(spark: SparkSession, d: str) -> DataFrame:
    """AG50, TK1, TK2, TK6: the ten best and worst."""
    a = table(spark, d, "answer_records").where("top_score is not null").select("answer_id", "top_score").distinct()
    top = lambda n, *o: a.orderBy(*o, "answer_id").limit(10).select(F.lit(n).alias("side"), "answer_id", "top_score")
    return top("best", F.desc("top_score")).union(top("worst", F.col("top_score")))


_SENT = r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
e AS (SELECT doc_id, len(s) AS n, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s),
v AS (SELECT doc_id, i, len(x) AS c, CAST(contains(lower(x), 'leishmania') AS INT) * 2 + CAST(contains(lower(x), 'lesion') AS INT) + CAST(n - i < 4 AS INT) AS v FROM e)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    e = s.select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("p", "x")).withColumn("i", (F.col("p") + 1).cast("bigint"))
    has = lambda w: F.contains(F.lower("x"), F.lit(w)).cast("int")
    return e.select("doc_id", "i", F.length("x").cast("bigint").alias("c"), (has("leishmania") * 2 + has("lesion") + (F.col("n") - F.col("i") < 4).cast("int")).alias("v"))


@query(_SENT + " SELECT doc_id, i, v FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, i) <= 3")
def extractive_spans(spark: SparkSession, d: str) -> DataFrame:
    """WN16: the three sentences that say most, with a bonus for the end."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("v"), "i")
    return _sentences(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("doc_id", "i", "v")


@query(_SENT + ", w AS (SELECT doc_id, i, v + coalesce(lead(v) OVER (PARTITION BY doc_id ORDER BY i), 0) AS v FROM v) SELECT doc_id, max(v) AS best, min_by(i, struct_pack(a := -v, b := i)) AS at FROM w GROUP BY 1")
def sentence_window(spark: SparkSession, d: str) -> DataFrame:
    """WN17: the best window of two sentences."""
    nxt = F.coalesce(F.lead("v").over(Window.partitionBy("doc_id").orderBy("i")), F.lit(0))
    return _sentences(spark, d).select("doc_id", "i", (F.col("v") + nxt).alias("v")).groupBy("doc_id").agg(F.max("v").alias("best"), F.min_by("i", F.struct(-F.col("v"), F.col("i"))).alias("at"))


@query(_SENT + ", r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM v) SELECT doc_id, count(*) AS kept, CAST(sum(c) AS BIGINT) AS chars FROM r WHERE s <= 600 GROUP BY 1")
def sentence_budget(spark: SparkSession, d: str) -> DataFrame:
    """SC35, SC36: leading sentences within a budget."""
    run = F.sum("c").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return _sentences(spark, d).withColumn("s", run).where("s <= 600").groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("c").alias("chars"))


@query("""SELECT qid, count(DISTINCT model_name) AS models, bool_and(coalesce(answer_format_valid, false)) AS all_valid, bool_or(coalesce(answer_format_valid, false)) AS any_valid FROM answer_records WHERE qid IS NOT NULL GROUP BY 1""")
def watch_list(spark: SparkSession, d: str) -> DataFrame:
    """All or any over the runs of a question."""
    v = F.coalesce("answer_format_valid", F.lit(False))
    return table(spark, d, "answer_records").where("qid is not null").groupBy("qid").agg(F.count_distinct("model_name").alias("models"), F.bool_and(v).alias("all_valid"), F.bool_or(v).alias("any_valid"))


@query("""WITH m AS (SELECT coalesce(model_name, '') AS model, avg(top_score) AS score, avg(format_retry_count) AS retries, avg(prompt_context_count) AS contexts FROM answer_records GROUP BY 1),
u AS (SELECT model, 'score' AS metric, score AS v FROM m UNION ALL SELECT model, 'retries', retries FROM m UNION ALL SELECT model, 'contexts', contexts FROM m)
SELECT metric, model, round(v, 6) AS value, row_number() OVER (PARTITION BY metric ORDER BY v DESC, model) AS place FROM u QUALIFY place <= 3""")
def top_per_metric(spark: SparkSession, d: str) -> DataFrame:
    """TK7: the three best models of each measure, from an unpivoted table."""
    m = table(spark, d, "answer_records").groupBy(F.coalesce("model_name", F.lit("")).alias("model")).agg(F.avg("top_score").alias("score"), F.avg("format_retry_count").alias("retries"), F.avg("prompt_context_count").alias("contexts"))
    u = m.unpivot("model", ["score", "retries", "contexts"], "metric", "v")
    return u.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("v"), "model"))).where("place <= 3").select("metric", "model", F.round("v", 6).alias("value"), "place")


@query("SELECT vec_id, round(CAST(s[1] AS DOUBLE), 6) AS top, round(CAST(s[1] AS DOUBLE) - CAST(s[2] AS DOUBLE), 6) AS gap FROM (SELECT vec_id, list_reverse_sort(embedding) AS s FROM embeddings)")
def label_gap(spark: SparkSession, d: str) -> DataFrame:
    """TK13: first and second score of a row."""
    s = F.sort_array("embedding", asc=False)
    a, b = (F.element_at(s, i).cast("double") for i in (1, 2))
    return table(spark, d, "embeddings").select("vec_id", F.round(a, 6).alias("top"), F.round(a - b, 6).alias("gap"))


_DENSE64 = L._DENSE.replace("rank <= 10", "rank <= 64")
_PARTS = "[CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]), CAST(embedding[33:48] AS DOUBLE[]), CAST(embedding[49:64] AS DOUBLE[])]"


@query(_DENSE64 + f""", t AS (SELECT vec_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM (SELECT vec_id, {_PARTS} AS p FROM embeddings)),
b AS (SELECT r.qid, r.doc_id, q.i, max(list_dot_product(q.x, k.x)) AS m FROM r JOIN t q ON q.vec_id = r.qid JOIN t k ON k.vec_id = r.doc_id GROUP BY ALL),
f AS (SELECT qid, doc_id, round(sum(m), 6) AS score FROM b GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5""")
def maxsim(spark: SparkSession, d: str) -> DataFrame:
    """TK14: late interaction over the 64 nearest, each vector taken as four parts."""
    t = table(spark, d, "embeddings").select("vec_id", F.expr("transform(sequence(0, 3), i -> cast(slice(embedding, i * 16 + 1, 16) as array<double>))").alias("p"))
    near = L._dense(spark, d, 64).select("qid", "doc_id")
    x = near.join(t.select(F.col("vec_id").alias("qid"), F.col("p").alias("q")), "qid").join(t.select(F.col("vec_id").alias("doc_id"), F.col("p").alias("k")), "doc_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    score = F.aggregate(F.transform("q", lambda a: F.array_max(F.transform("k", lambda b: dot(a, b)))), F.lit(0.0), lambda s, v: s + v)
    return K.ranked(x.select("qid", "doc_id", F.round(score, 6).alias("score")), 5)


@query(L._RUN.replace("grade\nFROM", "grade, bool_or(coalesce(micrograph_like, false)) AS domain\nFROM") + """, g AS (SELECT qid, doc_id, score, domain FROM run)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY domain DESC, score DESC, doc_id) AS place FROM g QUALIFY place <= 5""")
def domain_first(spark: SparkSession, d: str) -> DataFrame:
    """TK15, TK16: hits of the domain first, then others up to five."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and score is not null")
    g = h.groupBy(F.col("question_id").alias("qid"), F.concat("doc_id", F.lit(":"), F.col("page_index").cast("string")).alias("doc_id")).agg(F.max("score").alias("score"), F.max(F.coalesce("micrograph_like", F.lit(False))).alias("domain"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("domain"), F.desc("score"), "doc_id"))).where("place <= 5").select("qid", "doc_id", "score", "place")


@query(L._RUN + """, p AS (SELECT qid, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY round(grade * 10 + score - 0.05 * rank, 9) DESC, doc_id) AS k FROM run)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM p WHERE k <= 3""")
def prune_contexts(spark: SparkSession, d: str) -> DataFrame:
    """RT29: the three most useful contexts, in their first order."""
    use = F.round(F.col("grade") * 10 + F.col("score") - 0.05 * F.col("rank"), 9)
    p = K.ranked(L._hits(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(use.desc(), "doc_id"))).where("k <= 3")
    return p.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("place"))


@query(L._RUN + """, m AS (SELECT qid, max(score) - min(score) < 0.2 AS refine FROM run WHERE rank <= 3 GROUP BY 1),
s AS (SELECT qid, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, score DESC, doc_id) AS r2, refine FROM run JOIN m USING (qid)),
f AS (SELECT qid, doc_id, round(CAST(1.0 / (60 + rank) + CASE WHEN refine THEN 1.0 / (60 + r2) ELSE 0 END AS DOUBLE), 9) AS score FROM s)
SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM f""")
def refine_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """RT26: a second ordering is fused in where the first is undecided."""
    run = K.ranked(L._hits(spark, d))
    flag = run.where("rank <= 3").groupBy("qid").agg((F.max("score") - F.min("score") < 0.2).alias("refine"))
    r2 = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), F.desc("score"), "doc_id"))
    s = run.withColumn("r2", r2).join(flag, "qid")
    score = F.round(1.0 / (60 + F.col("rank")) + F.when(F.col("refine"), 1.0 / (60 + F.col("r2"))).otherwise(0.0), 9)
    return s.select("qid", "doc_id", score.alias("score")).select("qid", "doc_id", F.row_number().over(K.by_score()).alias("place"))


@query(L._DENSE + """ SELECT label, count(DISTINCT qid) AS queries, round(count(DISTINCT qid) FILTER (rank = 1 AND rel) / count(DISTINCT qid), 6) AS hit_1, round(count(DISTINCT qid) FILTER (rank <= 5 AND rel) / count(DISTINCT qid), 6) AS hit_5
FROM r JOIN v ON v.vec_id = qid GROUP BY label""")
def hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """EV39: hits among the first one and five, by label."""
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    r = L._dense(spark, d, 5).join(lab.select(F.col("vec_id").alias("qid"), "label"), "qid").join(lab.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id")
    per = r.groupBy("qid", "label").agg(F.max((F.col("rank") == 1) & (F.col("dl") == F.col("label"))).cast("int").alias("a"), F.max(F.col("dl") == F.col("label")).cast("int").alias("b"))
    return per.groupBy("label").agg(F.count("*").alias("queries"), F.round(F.avg("a"), 6).alias("hit_1"), F.round(F.avg("b"), 6).alias("hit_5"))


@query("""WITH m AS (SELECT qid, avg(top_score) FILTER (lower(model_name) = 'mgen-4b') AS a, avg(top_score) FILTER (lower(model_name) = 'mgen-27b') AS b, max(coalesce(nullif(trim(query_type), ''), '-')) AS bucket FROM answer_records WHERE qid IS NOT NULL GROUP BY 1)
SELECT bucket, count_if(b > a) AS improved, count_if(b < a) AS degraded, count_if(b = a) AS same, round(avg(b - a), 6) AS mean_delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY bucket""")
def loser_sets(spark: SparkSession, d: str) -> DataFrame:
    """EV34, EV35, EV38: two runs compared question by question."""
    s = lambda m: F.avg(F.when(F.lower("model_name") == m, F.col("top_score")))
    m = table(spark, d, "answer_records").where("qid is not null").groupBy("qid").agg(s("mgen-4b").alias("a"), s("mgen-27b").alias("b"), F.max(F.coalesce(F.nullif(F.trim("query_type"), F.lit("")), F.lit("-"))).alias("bucket"))
    a, b = F.col("a"), F.col("b")
    return m.where("a is not null and b is not null").groupBy("bucket").agg(F.count_if(b > a).alias("improved"), F.count_if(b < a).alias("degraded"), F.count_if(b == a).alias("same"), F.round(F.avg(b - a), 6).alias("mean_delta"))


@query("""SELECT coalesce(model_name, '') AS model, count_if(generation_mode = 'rag') AS rag, count_if(generation_mode IS NULL) AS none, count(*) AS n, round(avg(top_score), 6) AS mean_score FROM answer_records GROUP BY 1""")
def arm_matrix(spark: SparkSession, d: str) -> DataFrame:
    """EV37, AG41: model by mode."""
    return table(spark, d, "answer_records").groupBy(F.coalesce("model_name", F.lit("")).alias("model")).agg(
        F.count_if(F.col("generation_mode") == "rag").alias("rag"), F.count_if(F.col("generation_mode").isNull()).alias("none"), F.count("*").alias("n"), F.round(F.avg("top_score"), 6).alias("mean_score")
    )


@query("""SELECT question_id, coalesce(string_agg(DISTINCT page_index::VARCHAR, ',' ORDER BY page_index::VARCHAR) FILTER (micrograph_like), string_agg(DISTINCT page_index::VARCHAR, ',' ORDER BY page_index::VARCHAR) FILTER (via = 'seed_image'), '0,1,2') AS gold
FROM page_hits WHERE question_id IS NOT NULL GROUP BY 1""")
def gold_pages(spark: SparkSession, d: str) -> DataFrame:
    """Gold pages from the first source that knows any."""
    pages = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("page_index").cast("string")))), ","), F.lit(""))
    return table(spark, d, "page_hits").where("question_id is not null").groupBy("question_id").agg(F.coalesce(pages(F.col("micrograph_like")), pages(F.col("via") == "seed_image"), F.lit("0,1,2")).alias("gold"))


@query("""SELECT DISTINCT a.answer_id, coalesce(a.answer_format_valid, f.v) AS verdict, coalesce(a.answer_format_valid <> f.v, false) AS disagree FROM answer_records a
LEFT JOIN (SELECT answer_id, bool_or(answer_format_valid) AS v FROM format_analyses GROUP BY 1) f USING (answer_id)""")
def judge_resolution(spark: SparkSession, d: str) -> DataFrame:
    """EV30: the first verdict there is, and whether two disagree."""
    f = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.max("answer_format_valid").alias("v"))
    a = table(spark, d, "answer_records").select("answer_id", F.col("answer_format_valid").alias("x")).distinct().join(f, "answer_id", "left")
    return a.select("answer_id", F.coalesce("x", "v").alias("verdict"), F.coalesce(F.col("x") != F.col("v"), F.lit(False)).alias("disagree")).distinct()


@query("""SELECT hit_id, array_to_string(list_sort(list_distinct(flatten(list_transform(keywords, lambda k: [k, replace(k, '-', ''), replace(k, '-', ' ')])))), '|') AS variants FROM (SELECT DISTINCT hit_id, keywords FROM page_hits WHERE keywords IS NOT NULL)""")
def keyword_variants(spark: SparkSession, d: str) -> DataFrame:
    """PF14, IO19: spellings of each keyword."""
    k = table(spark, d, "page_hits").where("keywords is not null").select("hit_id", "keywords").distinct()
    v = F.flatten(F.transform("keywords", lambda x: F.array(x, F.replace(x, F.lit("-"), F.lit("")), F.replace(x, F.lit("-"), F.lit(" ")))))
    return k.select("hit_id", F.array_join(F.array_sort(F.array_distinct(v)), "|").alias("variants"))


@query(r"""SELECT hit_id, CAST(len(regexp_extract_all(lit, '''([^'']*)''', 1)) AS INT) AS items, coalesce(regexp_extract_all(lit, '''([^'']*)''', 1)[1], '') AS first FROM (SELECT hit_id, '[' || array_to_string(list_transform(keywords, lambda k: '''' || replace(k, '''', '') || ''''), ', ') || ']' AS lit
FROM (SELECT DISTINCT hit_id, keywords FROM page_hits WHERE len(keywords) > 0))""")
def list_literals(spark: SparkSession, d: str) -> DataFrame:
    """SC25, SC59: quoted list texts read back as arrays."""
    k = table(spark, d, "page_hits").where("size(keywords) > 0").select("hit_id", "keywords").distinct()
    lit = F.concat(F.lit("["), F.array_join(F.transform("keywords", lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("")), F.lit("'"))), ", "), F.lit("]"))
    parsed = F.regexp_extract_all(lit, F.lit("'([^']*)'"), F.lit(1))
    return k.select("hit_id", F.size(parsed).alias("items"), F.coalesce(F.get(parsed, F.lit(0)), F.lit("")).alias("first"))


@query(r"""WITH a AS (SELECT DISTINCT answer_id, answer FROM answer_records WHERE answer IS NOT NULL), s AS (SELECT answer_id, list_filter(list_transform(regexp_split_to_array(lower(answer), '[.!?\n]'), lambda x: trim(x)), lambda x: regexp_matches(x, '[a-z0-9]')) AS s FROM a)
SELECT answer_id, len(s) AS sentences, len(list_distinct(s)) AS distinct_sentences, len(list_filter(s, lambda x: regexp_matches(x, '^\W*rank [0-9]'))) AS points FROM s""")
def answer_points(spark: SparkSession, d: str) -> DataFrame:
    """SC38: sentences, their repeats, and numbered points of an answer."""
    a = table(spark, d, "answer_records").where("answer is not null").select("answer_id", "answer").distinct()
    s = F.filter(F.transform(F.split(F.lower("answer"), r"[.!?\n]"), lambda x: F.trim(x)), lambda x: x.rlike("[a-z0-9]"))
    return a.select("answer_id", F.size(s).cast("bigint").alias("sentences"), F.size(F.array_distinct(s)).cast("bigint").alias("distinct_sentences"), F.size(F.filter(s, lambda x: x.rlike(r"^\W*rank [0-9]"))).cast("bigint").alias("points"))


@query("""SELECT doc_id, round(least(1, length(text) / 2000.0) * 0.5 + CASE WHEN lower(text) LIKE '%biopsy%' THEN 0.3 ELSE 0 END + CASE WHEN article_id IS NOT NULL THEN 0.2 ELSE 0 END, 6)::DOUBLE AS quality,
CASE WHEN length(text) < 20 THEN 'quarantine' WHEN length(text) < 100 THEN 'review' ELSE 'index' END AS action, round(try_cast(n_chars AS DOUBLE) / length(text) - 1, 6) AS change FROM documents""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """MV15, PF17, SC1: weighted quality, an action, and a relative change."""
    n = F.length("text")
    q = F.least(F.lit(1.0), n / 2000.0) * 0.5 + F.when(F.lower("text").contains("biopsy"), 0.3).otherwise(0.0) + F.when(F.col("article_id").isNotNull(), 0.2).otherwise(0.0)
    return table(spark, d, "documents").select("doc_id", F.round(q, 6).alias("quality"), F.when(n < 20, "quarantine").when(n < 100, "review").otherwise("index").alias("action"), F.round(T.number_or_null(F.col("n_chars")) / n - 1, 6).alias("change"))


@query("""WITH q AS (SELECT DISTINCT query_id, query_type, case_id FROM eval_queries WHERE case_id IS NOT NULL)
SELECT query_id, array_to_string([p || ' ' || case_id], '') AS prompt FROM q, LATERAL (SELECT unnest(CASE WHEN query_type LIKE '%exposure%' THEN ['Where was the exposure of', 'Which vector fits'] ELSE ['Which diagnosis fits'] END) AS p)""")
def template_questions(spark: SparkSession, d: str) -> DataFrame:
    """SC49, SC50, SG16: questions from the templates of their type."""
    q = table(spark, d, "eval_queries").where("case_id is not null").select("query_id", "query_type", "case_id").distinct()
    t = F.when(F.col("query_type").like("%exposure%"), F.array(F.lit("Where was the exposure of"), F.lit("Which vector fits"))).otherwise(F.array(F.lit("Which diagnosis fits")))
    return q.select("query_id", F.explode(t).alias("p"), "case_id").select("query_id", F.concat_ws(" ", "p", "case_id").alias("prompt"))


@query(L._INDEX + """,
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), s AS (SELECT qid, doc_id, round(count(*) / sqrt(n), 6) AS score FROM q JOIN p USING (term) JOIN n USING (doc_id) GROUP BY qid, doc_id, n)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def kb_overlap(spark: SparkSession, d: str) -> DataFrame:
    """``kb_overlap_whole`` asked with short labels, as its SQL is."""
    index = written(L._index(spark, d), "postings")
    return S.once_each(L._queries(spark, d), lambda asked: K.ranked(S.overlap(index, asked).withColumn("score", F.round("score", 6)), 5))


@query(None)
def kb_overlap_whole(spark: SparkSession, d: str) -> DataFrame:
    """Terms shared with a query's whole text over the root of a document's number of terms."""
    return S.overlap_top_k(L._terms(spark, d), L._contexts(spark, d).where(L._STATED), 5)


@query(None)
def alpha_fusion(spark: SparkSession, d: str) -> DataFrame:
    """RT22: two lanes blended by their standard scores with fixed weights."""
    w = Window.partitionBy("qid")
    lane = lambda df, n: K.ranked(df, 50).select("qid", "doc_id", K.z_score(F.col("score"), w).alias(n))
    docs, asked = written(L._terms(spark, d), "terms"), written(L._contexts(spark, d), "asked")
    a, b = lane(S.bm25_top_k(docs, asked, 50), "a"), lane(S.tf_idf_top_k(docs, asked, 50), "b")
    both = a.join(b, ["qid", "doc_id"], "full").select("qid", "doc_id", (0.7 * F.coalesce("a", F.lit(0.0)) + 0.3 * F.coalesce("b", F.lit(0.0))).alias("score"))
    return K.ranked(both, 10)


@query(None)
def chunk_section(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs packed to a token budget; a long paragraph stays whole."""
    return S.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH t AS (SELECT DISTINCT entry_id AS entity, type_code, array_to_string(list_filter(regexp_split_to_array(lower(s), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') AS term FROM
(SELECT entry_id, type_code, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS s FROM diagnosis_catalog WHERE list_name = 'diagnosis')),
v AS (SELECT DISTINCT rank1_diagnosis_text AS v FROM format_analyses WHERE rank1_diagnosis_text IS NOT NULL), w AS (SELECT v, list_filter(regexp_split_to_array(lower(v), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM v),
i AS (SELECT v, w, unnest(range(1, len(w) + 1)) AS i FROM w), r AS (SELECT DISTINCT v, array_to_string(w[i : i + n - 1], ' ') AS term FROM i, range(1, 7) x(n) WHERE i + n - 1 <= len(w))
SELECT v AS value, type_code FROM r JOIN t USING (term) QUALIFY row_number() OVER (PARTITION BY v ORDER BY length(term) DESC, entity) = 1""")
def alias_infer(spark: SparkSession, d: str) -> DataFrame:
    """SC13, SC15, SC16, SC18, SC26, SC57: the type of the longest name that a text holds."""
    c = table(spark, d, "diagnosis_catalog").where("list_name = 'diagnosis'")
    terms = c.select("entry_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    v = table(spark, d, "format_analyses").where("rank1_diagnosis_text is not null").select(F.col("rank1_diagnosis_text").alias("value")).distinct()
    m = N.dictionary_mentions(v.withColumn("text", F.col("value")), "value", "text", terms, "term", "entry_id")
    best = keep_first(m, ["doc_id"], [F.desc(F.length("term")), F.col("entity")])
    return best.join(c.select(F.col("entry_id").alias("entity"), "type_code"), "entity").select(F.col("doc_id").alias("value"), "type_code")


@query("""SELECT DISTINCT label_id, confidence FROM diagnosis_labels WHERE regexp_matches(lower(concat_ws(' ', diagnosis, confirmation_method, evidence_span)), 'pcr|biopsy')
AND coalesce(is_leishmaniasis, false) AND confidence IN ('high', 'medium')""")
def concat_filter(spark: SparkSession, d: str) -> DataFrame:
    """PF4, PF8, PF9: a pattern over joined fields, a flag and a set."""
    x = table(spark, d, "diagnosis_labels").where(F.coalesce("is_leishmaniasis", F.lit(False)) & F.col("confidence").isin("high", "medium"))
    return x.where(F.lower(F.concat_ws(" ", "diagnosis", "confirmation_method", "evidence_span")).rlike("pcr|biopsy")).select("label_id", "confidence").distinct()


@query("""SELECT coalesce(model_name, '') AS model, count(*) AS n FROM answer_records GROUP BY 1
HAVING greatest(abs(coalesce(avg(top_score), 0)), abs(coalesce(avg(format_retry_count), 0)), abs(coalesce(avg(prompt_context_count), 0))) > 0""")
def nonzero_systems(spark: SparkSession, d: str) -> DataFrame:
    """PF23: systems with any measure that is not zero."""
    m = lambda c: F.abs(F.coalesce(F.avg(c), F.lit(0.0)))
    x = table(spark, d, "answer_records").groupBy(F.coalesce("model_name", F.lit("")).alias("model")).agg(F.count("*").alias("n"), F.greatest(m("top_score"), m("format_retry_count"), m("prompt_context_count")).alias("top"))
    return x.where("top > 0").select("model", "n")


@query("""SELECT doc_id, page_index, count(DISTINCT image_path) AS images, string_agg(DISTINCT image_path, '|' ORDER BY image_path) AS paths FROM page_hits
WHERE doc_id IS NOT NULL AND page_index IS NOT NULL AND image_path IS NOT NULL GROUP BY ALL""")
def page_images(spark: SparkSession, d: str) -> DataFrame:
    """JN26: the images of each page."""
    h = table(spark, d, "page_hits").where("doc_id is not null and page_index is not null and image_path is not null")
    return h.groupBy("doc_id", "page_index").agg(F.count_distinct("image_path").alias("images"), F.array_join(F.array_sort(F.collect_set("image_path")), "|").alias("paths"))


@query("""WITH p AS (SELECT answer_id, max(prompt_context_doc_ids) AS ids FROM answer_records GROUP BY 1),
x AS (SELECT answer_id, generate_subscripts(ids, 1) AS pos, unnest(ids) AS case_id FROM p)
SELECT answer_id, pos, case_id, case_id IN (SELECT case_id FROM diagnosis_labels WHERE case_id IS NOT NULL) AS labelled FROM x WHERE case_id IS NOT NULL""")
def plan_slices(spark: SparkSession, d: str) -> DataFrame:
    """An ordered plan of keys joined with their source by position."""
    p = table(spark, d, "answer_records").groupBy("answer_id").agg(F.max("prompt_context_doc_ids").alias("ids"))
    x = p.select("answer_id", F.posexplode("ids").alias("p", "case_id")).where("case_id is not null").withColumn("pos", (F.col("p") + 1).cast("bigint"))
    known = table(spark, d, "diagnosis_labels").where("case_id is not null").select("case_id").distinct().withColumn("k", F.lit(True))
    return x.join(known, "case_id", "left").select("answer_id", "pos", "case_id", F.coalesce("k", F.lit(False)).alias("labelled"))


@query("""SELECT DISTINCT query_id, concat_ws(' / ', ground_truth.diagnosis, ground_truth.diagnosis_type) AS term, split_part(ground_truth.diagnosis, ' ', 1) AS head FROM eval_queries WHERE ground_truth.diagnosis IS NOT NULL""")
def pruned_struct(spark: SparkSession, d: str) -> DataFrame:
    """SC24, SC52: a nested field dropped, the others as term and qualifier."""
    q = table(spark, d, "eval_queries").select("query_id", F.col("ground_truth").dropFields("species").alias("g")).where("g.diagnosis is not null")
    return q.select("query_id", F.concat_ws(" / ", "g.diagnosis", "g.diagnosis_type").alias("term"), F.split("g.diagnosis", " ")[0].alias("head")).distinct()


@query("""SELECT question_id, round(count(DISTINCT rank) FILTER (rank BETWEEN 1 AND 5) / 5.0, 6)::DOUBLE AS recall FROM page_hits WHERE question_id IS NOT NULL GROUP BY 1""")
def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Distinct matched places within the expected ones."""
    h = table(spark, d, "page_hits").where("question_id is not null").groupBy("question_id").agg(F.collect_set("rank").alias("r"))
    return h.select("question_id", F.round(F.size(F.filter("r", lambda x: x.between(1, 5))) / 5.0, 6).alias("recall"))
