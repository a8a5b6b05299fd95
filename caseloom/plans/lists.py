"""Search lanes, ranked lists, their measures and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import evaluation as E
from caseloom.operators import ranking as K
from caseloom.operators import retrieval as S
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


# The stated query set of the searches is every row whose id is divisible by 20; alpha_fusion, bm25_search, hybrid_rrf and kb_overlap ask with all rows.
_STATED = "qid % 20 = 0"
_TERMS = "list_filter(regexp_split_to_array(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '')"
_INDEX = f"""WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT query_id AS qid, w AS term, count(*) AS qtf FROM (SELECT DISTINCT query_id, ground_truth.diagnosis AS g FROM eval_queries WHERE ground_truth.diagnosis IS NOT NULL),
  LATERAL (SELECT unnest({_TERMS.format('g')}) AS w) GROUP BY ALL)"""
_STATED_INDEX = _INDEX.replace("WHERE ground_truth", "WHERE query_id % 20 = 0 AND ground_truth")
_BM25 = """,
st AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT doc_id, any_value(dl) AS dl FROM p GROUP BY 1)),
i0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, st GROUP BY term, n),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
b AS (SELECT qid, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN i USING (term) JOIN p USING (term), st GROUP BY ALL),
bm AS (SELECT qid, doc_id, round(score, 6) AS score FROM b WHERE score > 0)"""
_TFIDF = """,
w AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT doc_id) FROM p)) / (1.0 + count(*))) + 1 AS idf FROM p GROUP BY term),
dn AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS dn FROM p JOIN w USING (term) GROUP BY 1),
qn AS (SELECT qid, sqrt(sum(qtf * idf * qtf * idf)) AS qn FROM q JOIN w USING (term) GROUP BY 1),
tf AS (SELECT qid, doc_id, round(sum(qtf * idf * p.tf * idf) / (qn * dn), 6) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN dn USING (doc_id) JOIN qn USING (qid) GROUP BY qid, doc_id, qn, dn)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_queries").select(F.col("query_id").alias("qid"), F.col("ground_truth.diagnosis").alias("g")).where("g is not null").distinct()
    return q.select("qid", F.explode(T.tokens(F.col("g"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the whole text of a query: its clinical context or, where that is blank, its formatted query."""
    text = F.coalesce(*[F.when(F.col(c).rlike(r"\S"), F.col(c)) for c in ("clinical_context", "formatted_query")])
    q = table(spark, d, "eval_queries").select(F.col("query_id").alias("qid"), text.alias("g")).where("g is not null").repartition("qid").distinct()  # terms are counted without another shuffle
    return q.select("qid", F.explode(T.tokens(F.col("g"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))


def _bm25(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    return K.ranked(S.bm25(index, asked).withColumn("score", F.round("score", 6)), k)


def _tfidf(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    return K.ranked(S.tf_idf(index, asked).withColumn("score", F.round("score", 6)), k)


def _hybrid(asked: DataFrame, index: DataFrame) -> DataFrame:
    lanes = [(_bm25(asked, index, 20), 0.6), (_tfidf(asked, index, 20), 0.4)]
    return K.ranked(K.reciprocal_rank_fusion(lanes).withColumn("score", F.round("score", 8)), 10)


@query(_INDEX + _BM25 + " SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """``bm25_search_whole`` asked with short labels, as its SQL is."""
    index = written(_index(spark, d), "postings")
    return S.once_each(_queries(spark, d), lambda asked: _bm25(asked, index, 10))


@query(None)
def bm25_search_whole(spark: SparkSession, d: str) -> DataFrame:
    """RT7, RT8, TK5: BM25 top ten of the queries' whole texts in blocks of documents and queries."""
    return S.bm25_top_k(written(_terms(spark, d), "terms"), _contexts(spark, d).where(_STATED), 10)


@query(_STATED_INDEX + _TFIDF + " SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM tf QUALIFY rank <= 10")
def tfidf_search(spark: SparkSession, d: str) -> DataFrame:
    """``tfidf_search_whole`` asked with short labels, as its SQL is."""
    index = written(_index(spark, d), "postings")
    return S.once_each(_queries(spark, d).where(_STATED), lambda asked: _tfidf(asked, index, 10))


@query(None)
def tfidf_search_whole(spark: SparkSession, d: str) -> DataFrame:
    """RT21: tf-idf cosine top ten of the queries' whole texts."""
    return S.tf_idf_top_k(written(_terms(spark, d), "terms"), _contexts(spark, d).where(_STATED), 10)


@query(_INDEX + _BM25 + _TFIDF + """,
l AS (SELECT qid, doc_id, 0.6 AS w, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20
UNION ALL SELECT qid, doc_id, 0.4, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM tf QUALIFY r <= 20),
f AS (SELECT qid, doc_id, round(CAST(sum(w / (60.0 + r)) AS DOUBLE), 8) AS score FROM l GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """``hybrid_rrf_whole`` asked with short labels, as its SQL is."""
    index = written(_index(spark, d), "postings")  # one index for both lanes
    return S.once_each(_queries(spark, d), lambda asked: _hybrid(asked, index))


@query(None)
def hybrid_rrf_whole(spark: SparkSession, d: str) -> DataFrame:
    """RT10, RT11, RT13, RT14, RT15, AG8: two lanes of the queries' whole texts fused by reciprocal rank."""
    docs, asked = written(_terms(spark, d), "terms"), written(_contexts(spark, d).where(_STATED), "asked")  # shared by both lanes
    lanes = [(S.bm25_top_k(docs, asked, 20), 0.6), (S.tf_idf_top_k(docs, asked, 20), 0.4)]
    return K.ranked(K.reciprocal_rank_fusion(lanes).withColumn("score", F.round("score", 8)), 10)


_DENSE = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS score, q.label = v.label AS rel
FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)"""


def _dense(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = table(spark, d, "embeddings")
    return S.dense_top_k(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v")), k)


@query(_DENSE + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM r")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """RT9, RT12, TK3, MV1, MV3: exact cosine top ten in matrix blocks."""
    return _dense(spark, d).withColumn("score", F.round("score", 6))


@query(_DENSE + """, n AS (SELECT label, count(*) - 1 AS rel FROM embeddings GROUP BY 1)
SELECT qid, round(count_if(r.rel) / n.rel, 6) AS recall, round(count_if(r.rel) / count(*), 6) AS precision, round(coalesce(max(CASE WHEN r.rel THEN 1.0 / rank END), 0), 6) AS mrr,
round(sum(CASE WHEN r.rel THEN 1 / log2(rank + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n.rel), 6) AS ndcg
FROM r JOIN v ON v.vec_id = qid JOIN n ON n.label = v.label GROUP BY qid, n.rel""")
def retrieval_metrics_by_label(spark: SparkSession, d: str) -> DataFrame:
    """EV5 to EV8, EV10, MV5: measures of the dense lane; same label is relevant, counted and not paired."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    n = labels.groupBy("label").agg((F.count("*") - 1).alias("n_rel"))
    r = _dense(spark, d).join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dl")), "doc_id").join(labels.select(F.col("vec_id").alias("qid"), "label"), "qid").join(n, "label")
    rel, ideal = F.col("dl") == F.col("label"), F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return r.groupBy("qid", "n_rel").agg(
        F.round(F.count_if(rel) / F.col("n_rel"), 6).alias("recall"), F.round(F.count_if(rel) / F.count("*"), 6).alias("precision"),
        F.round(F.coalesce(F.max(F.when(rel, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("mrr"), F.round(F.sum(F.when(rel, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)) / F.first(ideal), 6).alias("ndcg"),
    ).drop("n_rel")


_RUN = """WITH h AS (SELECT question_id AS qid, doc_id || ':' || page_index AS doc_id, max(score) AS score, max(CASE WHEN page_kind = 'figure_or_micrograph' THEN 2 WHEN page_kind = 'mixed' THEN 1 ELSE 0 END) AS grade
FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM h)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits as a list per question: page, score, grade of the page."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and score is not null")
    kind = F.when(F.col("page_kind") == "figure_or_micrograph", 2).when(F.col("page_kind") == "mixed", 1).otherwise(0)
    return h.groupBy(F.col("question_id").alias("qid"), F.concat("doc_id", F.lit(":"), F.col("page_index").cast("string")).alias("doc_id")).agg(F.max("score").alias("score"), F.max(kind).alias("grade"))


@query(_RUN + """, j AS (SELECT * FROM run WHERE grade > 0), id AS (SELECT qid, count(*) AS n, sum(CASE WHEN r <= 5 THEN (2 ** grade - 1) / log2(r + 1) ELSE 0 END) AS idcg
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS r FROM j) GROUP BY 1),
c AS (SELECT *, sum(CAST(grade > 0 AS INT)) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS seen FROM run)
SELECT c.qid, round(coalesce(max(CASE WHEN grade > 0 THEN 1.0 / rank END), 0), 6) AS mrr, round(sum(CASE WHEN grade > 0 THEN seen / rank ELSE 0 END) / any_value(n), 6) AS ap,
round(count_if(rank <= 5 AND grade > 0) / any_value(n), 6) AS recall_5, round(count_if(rank <= 5 AND grade > 0) / count_if(rank <= 5), 6) AS precision_5,
round(sum(CASE WHEN rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) / any_value(idcg), 6) AS ndcg_5 FROM c JOIN id USING (qid) GROUP BY c.qid""")
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EV5 to EV12, WN15, AG37: graded measures of the page lists."""
    run = K.ranked(_hits(spark, d))
    m = E.retrieval_metrics(run.select("qid", "doc_id", "rank"), run.select("qid", "doc_id", "grade"), [5])
    return m.select("qid", *[F.round(c, 6).alias(c) for c in m.columns if c != "qid"])


@query(_RUN + """ SELECT qid, doc_id, rank, round(CASE WHEN stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 5) AS z,
round(score / max(score) OVER w, 6) AS share FROM run WINDOW w AS (PARTITION BY qid)""")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """WN1, WN12, WN13: ranks, standard scores and scores as part of the best."""
    w = Window.partitionBy("qid")
    return K.ranked(_hits(spark, d)).select("qid", "doc_id", "rank", F.round(K.z_score(F.col("score"), w), 5).alias("z"), F.round(F.col("score") / F.max("score").over(w), 6).alias("share"))


@query(_RUN + " SELECT qid, max_by(score, -rank) AS top, round(max(score) - min(score), 6) AS margin FROM run WHERE rank <= 3 GROUP BY 1")
def score_margin(spark: SparkSession, d: str) -> DataFrame:
    """WN9, RT26: first score less the third."""
    return K.score_margin(_hits(spark, d)).select("qid", "top", F.round("margin", 6).alias("margin"))


@query(_RUN + """, f AS (SELECT *, sum(CASE WHEN l - score > 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, lag(score) OVER (PARTITION BY qid ORDER BY rank) AS l FROM run)) SELECT qid, doc_id, score FROM f WHERE s = 0""")
def dynamic_k(spark: SparkSession, d: str) -> DataFrame:
    """WN10, RT28: the list up to the first large fall."""
    return K.dynamic_k(_hits(spark, d), 0.1).select("qid", "doc_id", "score")


@query(_RUN + " SELECT qid, doc_id, score, rank FROM run WHERE score >= 0.8 OR rank <= 2")
def min_k_threshold(spark: SparkSession, d: str) -> DataFrame:
    """WN11, PF16: a threshold that leaves at least two."""
    return K.threshold_with_minimum(_hits(spark, d), 0.8, 2).select("qid", "doc_id", "score", "rank")


@query("""WITH h AS (SELECT question_id AS qid, doc_id || ':' || page_index AS doc_id, via, max(score) AS score FROM page_hits
WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
u AS (SELECT qid, doc_id, score * CASE via WHEN 'dense' THEN 1.0 WHEN 'sparse' THEN 0.9 ELSE 1.3 END AS score, via FROM h WHERE via IN ('dense', 'sparse', 'seed_image'))
SELECT qid, doc_id, max(score) AS score, max_by(via, struct_pack(a := score, b := via)) AS via FROM u GROUP BY ALL""")
def weighted_merge(spark: SparkSession, d: str) -> DataFrame:
    """ST10, ST11, AG7: lanes merged to the best weighted score of a page."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and score is not null")
    h = h.groupBy(F.col("question_id").alias("qid"), F.concat("doc_id", F.lit(":"), F.col("page_index").cast("string")).alias("doc_id"), "via").agg(F.max("score").alias("score"))
    lanes = [(v, h.where(F.col("via") == v), w) for v, w in (("dense", 1.0), ("sparse", 0.9), ("seed_image", 1.3))]
    return K.max_merge(lanes)


@query(_RUN + """, g AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid, split_part(doc_id, ':', 1) ORDER BY score DESC, doc_id) AS k FROM run)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY (k > 1), score DESC, doc_id) AS rank FROM g QUALIFY rank <= 4""")
def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    """WN18, WN19: one page per document first, then filled up."""
    h = _hits(spark, d).withColumn("scan", F.split("doc_id", ":")[0])
    return K.diverse_selection(h, 4, 1, "scan").select("qid", "doc_id", "score", "rank")


@query(_RUN + """, n AS (SELECT qid, doc_id, rank, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, score DESC, doc_id) AS new_rank FROM run)
SELECT qid, round(avg(abs(rank - new_rank)), 6) AS mean_move, round(count_if(rank <= 3 AND new_rank <= 3) / least(3, count(*)), 6) AS overlap_3 FROM n GROUP BY qid""")
def rank_move(spark: SparkSession, d: str) -> DataFrame:
    """WN20, WN21: what a second ordering changes."""
    new = Window.partitionBy("qid").orderBy(F.desc("grade"), F.desc("score"), "doc_id")
    n = K.ranked(_hits(spark, d)).withColumn("new_rank", F.row_number().over(new))
    both = F.count_if((F.col("rank") <= 3) & (F.col("new_rank") <= 3)) / F.least(F.lit(3), F.count("*"))
    return n.groupBy("qid").agg(F.round(F.avg(F.abs(F.col("rank") - F.col("new_rank"))), 6).alias("mean_move"), F.round(both, 6).alias("overlap_3"))


@query(_RUN + """ SELECT qid, count(*) AS n, round(1 - count(DISTINCT split_part(doc_id, ':', 1)) / count(*), 6) AS duplicate_ratio,
CASE WHEN max(score) < 0.5 THEN 'abstain' WHEN max(score) - min(score) < 0.05 THEN 'flat' WHEN count_if(grade > 0) = 0 THEN 'unsupported' ELSE 'supported' END AS support FROM run WHERE rank <= 5 GROUP BY qid""")
def support_class(spark: SparkSession, d: str) -> DataFrame:
    """What a list can carry, by aggregates of its head."""
    r = K.ranked(_hits(spark, d), 5).groupBy("qid").agg(
        F.count("*").alias("n"), F.round(1 - F.count_distinct(F.split("doc_id", ":")[0]) / F.count("*"), 6).alias("duplicate_ratio"), F.max("score").alias("hi"), F.min("score").alias("lo"), F.count_if(F.col("grade") > 0).alias("rel")
    )
    return r.select("qid", "n", "duplicate_ratio", F.when(F.col("hi") < 0.5, "abstain").when(F.col("hi") - F.col("lo") < 0.05, "flat").when(F.col("rel") == 0, "unsupported").otherwise("supported").alias("support"))


_UNIT = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0)"


@query(f"""WITH a AS (SELECT answer_id, coalesce(model_name, '') AS model, max(top_score) AS s FROM answer_records GROUP BY ALL),
b AS (SELECT model, i AS replicate, sum(-ln(greatest({_UNIT.format("concat_ws('|', 42, i, answer_id)")}, 1e-12)) * s) / sum(-ln(greatest({_UNIT.format("concat_ws('|', 42, i, answer_id)")}, 1e-12))) AS m
FROM a, range(40) t(i) WHERE s IS NOT NULL GROUP BY ALL), l AS (SELECT model, list_sort(list(m)) AS m FROM b GROUP BY 1)
SELECT model, round(m[1 + CAST(floor(40 * 0.025) AS INT)], 6) AS low, round(m[1 + greatest(0, CAST(floor(40 * 0.975) AS INT) - 1)], 6) AS high FROM l""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of a mean from hashed weights, a Bayesian form of EV20."""
    a = table(spark, d, "answer_records").groupBy("answer_id", F.coalesce("model_name", F.lit("")).alias("model")).agg(F.max("top_score").alias("s"))
    ci = E.confidence_interval(E.bootstrap_means(a, "model", "answer_id", "s", 40), "model")
    return ci.select("model", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH a AS (SELECT answer_id, max(CAST(coalesce(answer_format_valid, false) AS INT)) AS x FROM answer_records GROUP BY 1),
b AS (SELECT answer_id, max(CAST(coalesce(answer_format_valid, false) AS INT)) AS y FROM format_analyses GROUP BY 1),
d AS (SELECT 'valid' AS test, answer_id, x - y AS dl FROM a JOIN b USING (answer_id)),
m AS (SELECT test, i, abs(avg(CASE WHEN {_UNIT.format("concat_ws('|', 42, i, answer_id)")} < 0.5 THEN -dl ELSE dl END)) AS m FROM d, range(30) t(i) GROUP BY ALL),
o AS (SELECT test, avg(dl) AS md FROM d GROUP BY 1)
SELECT test, round(md, 6) AS mean_delta, round((count_if(m >= abs(md) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM m JOIN o USING (test) GROUP BY test, md""")
def permutation_p(spark: SparkSession, d: str) -> DataFrame:
    """EV22, EV23, AG14: paired deltas with a sign-flip test."""
    v = lambda t, n: table(spark, d, t).groupBy("answer_id").agg(F.max(F.coalesce("answer_format_valid", F.lit(False)).cast("int")).alias(n))
    delta = v("answer_records", "x").join(v("format_analyses", "y"), "answer_id").select(F.lit("valid").alias("test"), "answer_id", (F.col("x") - F.col("y")).cast("double").alias("dl"))
    return E.sign_flip_p(delta, "test", "answer_id", "dl", 30).select("test", F.round("mean_delta", 6).alias("mean_delta"), F.round("p", 6).alias("p"))


@query("""WITH t AS (SELECT coalesce(retrieval_support_status, '') AS test, avg(top_score) / (count(*) + 1) AS p FROM answer_records WHERE top_score IS NOT NULL GROUP BY 1),
s AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) AS a FROM t)
SELECT test, round(p, 9) AS p, round(least(1, max(a) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM s""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    """WN14, EV26: stepwise adjustment of a table of tests."""
    t = table(spark, d, "answer_records").where("top_score is not null").groupBy(F.coalesce("retrieval_support_status", F.lit("")).alias("test")).agg((F.avg("top_score") / (F.count("*") + 1)).alias("p"))
    return E.holm(t).select("test", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


@query("""WITH j AS (SELECT a.v AS a, b.v AS b FROM (SELECT answer_id, bool_or(coalesce(answer_format_valid, false)) AS v FROM answer_records GROUP BY 1) a
JOIN (SELECT answer_id, bool_or(coalesce(answer_format_valid, false)) AS v FROM format_analyses GROUP BY 1) b USING (answer_id)),
k AS (SELECT avg(CAST(a = b AS INT)) AS po, avg(CAST(a AS INT)) * avg(CAST(b AS INT)) + (1 - avg(CAST(a AS INT))) * (1 - avg(CAST(b AS INT))) AS pe FROM j)
SELECT round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    """MV7: agreement beyond chance of two judgements."""
    v = lambda t, n: table(spark, d, t).groupBy("answer_id").agg(F.max(F.coalesce("answer_format_valid", F.lit(False)).cast("int")).alias(n))
    k = v("answer_records", "a").join(v("format_analyses", "b"), "answer_id").agg(F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    k = k.withColumn("pe", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    return k.select(F.round("po", 6).alias("agreement"), F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


@query("""WITH p AS (SELECT case_id, diagnosis FROM diagnosis_labels WHERE case_id IS NOT NULL AND diagnosis IS NOT NULL GROUP BY ALL),
g AS (SELECT case_id, ground_truth.diagnosis AS diagnosis FROM eval_queries WHERE case_id IS NOT NULL AND ground_truth.diagnosis IS NOT NULL GROUP BY ALL)
SELECT coalesce(diagnosis, 'all') AS diagnosis, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp / nullif(ng, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(np + ng, 0), 0), 6) AS f1 FROM (
SELECT diagnosis, count(p.case_id) AS np, count(g.case_id) AS ng, count_if(p.case_id IS NOT NULL AND g.case_id IS NOT NULL) AS tp FROM p FULL JOIN g USING (case_id, diagnosis) GROUP BY GROUPING SETS ((diagnosis), ()))""")
def set_prf(spark: SparkSession, d: str) -> DataFrame:
    """EV17, EV2, EV16: precision, recall and F1 of two sets, by kind and over all."""
    p = table(spark, d, "diagnosis_labels").select("case_id", "diagnosis").where("case_id is not null and diagnosis is not null").distinct().withColumn("p", F.lit(1))
    g = table(spark, d, "eval_queries").select("case_id", F.col("ground_truth.diagnosis").alias("diagnosis")).where("case_id is not null and diagnosis is not null").distinct().withColumn("g", F.lit(1))
    x = p.join(g, ["case_id", "diagnosis"], "full").rollup("diagnosis").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"))
    rate = lambda a, b, n: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6).alias(n)
    tp = F.col("tp")
    return x.select(F.coalesce("diagnosis", F.lit("all")).alias("diagnosis"), rate(tp, F.col("np"), "precision"), rate(tp, F.col("ng"), "recall"), rate(2 * tp, F.col("np") + F.col("ng"), "f1"))


@query("""WITH a AS (SELECT DISTINCT answer_id, answer FROM answer_records WHERE answer IS NOT NULL)
SELECT answer_id, regexp_extract(answer, '(?i)rank 1: *([^\\n]*)', 1) AS rank_1, regexp_extract(answer, '(?i)rank 2: *([^\\n]*)', 1) AS rank_2, NOT regexp_matches(answer, '(?i)rank 1:') AS missing_rank1_line FROM a""")
def rank_lines(spark: SparkSession, d: str) -> DataFrame:
    """SC14, SC17, EV28: ranked diagnoses written in answers."""
    a = table(spark, d, "answer_records").where("answer is not null").select("answer_id", "answer").distinct()
    get = lambda n: F.regexp_extract("answer", rf"(?i)rank {n}: *([^\n]*)", 1).alias(f"rank_{n}")
    return a.select("answer_id", get(1), get(2), (~F.col("answer").rlike("(?i)rank 1:")).alias("missing_rank1_line"))


@query(r"""SELECT answer_id, array_to_string(list_sort(list_filter([CASE WHEN regexp_replace(coalesce(answer, ''), '\s', '', 'g') = '' THEN 'empty' END, CASE WHEN coalesce(prompt_context_count, 0) = 0 THEN 'no_context' END,
CASE WHEN coalesce(top_score, 0) < 0.3 THEN 'weak_support' END, CASE WHEN format_retry_count > 1 THEN 'retried' END], lambda x: x IS NOT NULL)), ',') AS labels FROM answer_records""")
def failure_labels(spark: SparkSession, d: str) -> DataFrame:
    """EV32, PF17: several labels per row by rules."""
    label = lambda c, n: F.when(c, F.lit(n))
    labels = F.array_compact(F.array(
        label(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\s", "") == "", "empty"), label(F.coalesce("prompt_context_count", F.lit(0)) == 0, "no_context"),
        label(F.coalesce("top_score", F.lit(0.0)) < 0.3, "weak_support"), label(F.col("format_retry_count") > 1, "retried"),
    ))
    return table(spark, d, "answer_records").select("answer_id", F.array_join(F.array_sort(labels), ",").alias("labels"))


@query("""WITH b AS (SELECT label, i / 10.0 AS alpha FROM (SELECT DISTINCT label FROM embeddings), range(0, 11) t(i)),
v AS (SELECT label, avg(embedding[1]) AS a, avg(embedding[2]) AS c FROM embeddings GROUP BY 1)
SELECT label, CAST(max_by(alpha, struct_pack(s := round(alpha * a + (1 - alpha) * c, 9), t := -alpha)) AS DOUBLE) AS best_alpha FROM b JOIN v USING (label) GROUP BY label""")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Best linear blend of two label means over a grid, in part MV13; 0 or 1 but for ties."""
    v = table(spark, d, "embeddings").groupBy("label").agg(F.avg(F.element_at("embedding", 1).cast("double")).alias("a"), F.avg(F.element_at("embedding", 2).cast("double")).alias("c"))
    g = v.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / F.lit(10.0))))
    s = F.round(F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("c"), 9)
    return g.groupBy("label").agg(F.max_by("alpha", F.struct(s, -F.col("alpha"))).alias("best_alpha"))
