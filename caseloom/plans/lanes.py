"""Fusion, filtering, widening and reranking of lanes, and statistics of paired runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators import evaluation as E
from caseloom.operators import ranking as K
from caseloom.operators import sampling as P
from caseloom.plans.lists import _UNIT
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


_PAGES = """WITH h AS (SELECT question_id AS qid, doc_id, page_index, coalesce(via, '') AS via, max(score) AS score, bool_or(coalesce(page_kind, '') = 'mixed') AS mixed, bool_or(coalesce(micrograph_like, false)) AS micro,
any_value(text_excerpt) AS text FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL AND score IS NOT NULL GROUP BY ALL)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Distinct hits ``(qid, doc_id, page_index, via, score, mixed, micro, text)``; all hits of a page carry the same text."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and score is not null")
    return h.groupBy(F.col("question_id").alias("qid"), "doc_id", "page_index", F.coalesce("via", F.lit("")).alias("via")).agg(
        F.max("score").alias("score"), F.max(F.coalesce(F.col("page_kind") == "mixed", F.lit(False))).alias("mixed"), F.max(F.coalesce("micrograph_like", F.lit(False))).alias("micro"), F.max("text_excerpt").alias("text")
    )


@query(_PAGES + """, l AS (SELECT qid, doc_id, page_index, mixed, CASE WHEN via = 'dense' THEN 'a' ELSE 'b' END AS lane, max(score) AS score FROM h GROUP BY ALL),
m AS (SELECT *, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS x, row_number() OVER (PARTITION BY qid, lane ORDER BY score DESC, doc_id, page_index) AS r FROM l WINDOW w AS (PARTITION BY qid, lane)),
g AS (SELECT qid, CASE WHEN coalesce(max(score) FILTER (lane = 'a' AND r = 1) - min(score) FILTER (lane = 'a' AND r <= 3), 0) >= 0.1 THEN 0.7 ELSE 0.4 END AS alpha FROM m GROUP BY 1),
f AS (SELECT qid, doc_id, page_index, round(sum(coalesce(x, 1) * CASE WHEN lane = 'a' THEN alpha ELSE 1 - alpha END) + CASE WHEN bool_or(mixed) THEN 0.05 ELSE 0 END, 9) AS score FROM m JOIN g USING (qid) GROUP BY qid, doc_id, page_index)
SELECT qid, doc_id, page_index, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_index) AS rank FROM f QUALIFY rank <= 10""")
def late_fusion(spark: SparkSession, d: str) -> DataFrame:
    """RT18, RT22: lanes brought to 0..1 within a query and added; the weight follows how decided the dense lane is, one kind of page is boosted."""
    lane = F.when(F.col("via") == "dense", "a").otherwise("b")
    one = _pages(spark, d).groupBy("qid", "doc_id", "page_index", lane.alias("lane")).agg(F.max("score").alias("score"), F.max("mixed").alias("mixed"))
    w = Window.partitionBy("qid", "lane")
    low, high = F.min("score").over(w), F.max("score").over(w)
    m = one.withColumn("x", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(1.0))).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "doc_id", "page_index")))
    dense = F.col("lane") == "a"
    margin = F.max(F.when(dense & (F.col("r") == 1), F.col("score"))) - F.min(F.when(dense & (F.col("r") <= 3), F.col("score")))
    g = m.groupBy("qid").agg(F.when(F.coalesce(margin, F.lit(0.0)) >= 0.1, 0.7).otherwise(0.4).alias("alpha"))
    part = F.col("x") * F.when(dense, F.col("alpha")).otherwise(1 - F.col("alpha"))
    f = m.join(g, "qid").groupBy("qid", "doc_id", "page_index").agg(F.round(F.sum(part) + F.when(F.max("mixed"), 0.05).otherwise(0.0), 9).alias("score"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "page_index"))).where("rank <= 10")


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, greatest(round(list_dot_product(q.a, v.a) / (sqrt(list_dot_product(q.a, q.a)) * sqrt(list_dot_product(v.a, v.a))), 9),
  round(0.8 * list_dot_product(q.b, v.b) / (sqrt(list_dot_product(q.b, q.b)) * sqrt(list_dot_product(v.b, v.b))), 9)) AS score
FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND v.label = q.label AND v.vec_id % 2 = 0)
SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def dual_vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    """RT19, RT12, PF13: two vectors a row, a filter that must hold (same label, even id), merged by the better weighted cosine.

    The filter is an equi-join on the label, so only rows that pass it meet.
    """
    half = lambda i: F.slice(F.col("embedding"), i, 32).cast("array<double>")
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = table(spark, d, "embeddings").select("vec_id", "label", unit(half(1)).alias("a"), unit(half(33)).alias("b"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("a").alias("qa"), F.col("b").alias("qb"))
    x = q.join(v.where("vec_id % 2 = 0"), "label").where("qid <> vec_id")
    score = F.greatest(F.round(dot("qa", "a"), 9), F.round(0.8 * dot("qb", "b"), 9))
    return K.ranked(x.select("qid", F.col("vec_id").alias("doc_id"), score.alias("score")), 5).withColumn("score", F.round("score", 6))


@query(_PAGES + """, p AS (SELECT qid, doc_id, page_index, max(score) AS score, bool_or(micro) AS micro FROM h GROUP BY ALL),
t AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, doc_id) AS k FROM p GROUP BY qid, doc_id QUALIFY k = 1),
s AS (SELECT qid, doc_id, page_index, round(score + CASE WHEN page_index <= 2 THEN 0.1 ELSE 0 END + CASE WHEN micro THEN 0.05 ELSE 0 END, 9) AS score FROM p JOIN t USING (qid, doc_id)),
n AS (SELECT qid, doc_id, page_index, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_index) <= 3),
b AS (SELECT qid, doc_id, page_index, CAST(0 AS DOUBLE) AS score FROM t JOIN (SELECT DISTINCT doc_id, page_index FROM h WHERE page_index <= 2) e USING (doc_id) ANTI JOIN n USING (qid, doc_id, page_index)),
u AS (SELECT * FROM n UNION ALL SELECT * FROM b) SELECT qid, doc_id, page_index, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_index) AS place FROM u QUALIFY place <= 5""")
def document_scope(spark: SparkSession, d: str) -> DataFrame:
    """RT20, RT23, RT34: the best document of a query, its pages with boosts for early and figure pages, filled up with its early pages that no hit brought."""
    h = _pages(spark, d)
    p = h.groupBy("qid", "doc_id", "page_index").agg(F.max("score").alias("score"), F.max("micro").alias("micro"))
    top = p.groupBy("qid", "doc_id").agg(F.max("score").alias("best"))
    t = top.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best"), "doc_id"))).where("k = 1").select("qid", "doc_id")
    boosted = F.round(F.col("score") + F.when(F.col("page_index") <= 2, 0.1).otherwise(0.0) + F.when(F.col("micro"), 0.05).otherwise(0.0), 9)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "page_index"))
    n = p.join(t, ["qid", "doc_id"]).select("qid", "doc_id", "page_index", boosted.alias("score")).withColumn("k", place).where("k <= 3").drop("k")
    early = h.where("page_index <= 2").select("doc_id", "page_index").distinct()
    b = t.join(early, "doc_id").join(n, ["qid", "doc_id", "page_index"], "left_anti").select("qid", "doc_id", "page_index", F.lit(0.0).alias("score"))
    return n.unionByName(b).withColumn("place", place).where("place <= 5")


@query(_PAGES + """, p AS (SELECT qid, doc_id, page_index, max(score) AS score FROM h GROUP BY ALL), c AS (SELECT qid, doc_id, max(score) AS best FROM p GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best DESC, doc_id) AS doc_rank FROM c QUALIFY doc_rank <= 3)
SELECT qid, doc_id, page_index, doc_rank, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, page_index) AS page_rank FROM p JOIN t USING (qid, doc_id) QUALIFY page_rank <= 2""")
def two_level_cut(spark: SparkSession, d: str) -> DataFrame:
    """TK8, RT17, RT23: the three best documents of a query and the two best pages of each."""
    p = _pages(spark, d).groupBy("qid", "doc_id", "page_index").agg(F.max("score").alias("score"))
    c = p.groupBy("qid", "doc_id").agg(F.max("score").alias("best"))
    t = c.withColumn("doc_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best"), "doc_id"))).where("doc_rank <= 3")
    pages = p.join(t, ["qid", "doc_id"]).withColumn("page_rank", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "page_index")))
    return pages.where("page_rank <= 2").select("qid", "doc_id", "page_index", "doc_rank", "page_rank")


_KINDS = "CASE WHEN regexp_matches(lower({0}), 'mucos|nasal|oral') THEN 'mucosal' WHEN regexp_matches(lower({0}), 'spleen|marrow|fever|visceral') THEN 'visceral' WHEN regexp_matches(lower({0}), 'skin|ulcer|papule|plaque|cutan') THEN 'cutaneous' END"


def _kind(c) -> F.Column:
    low = F.lower(c)
    return F.when(low.rlike("mucos|nasal|oral"), "mucosal").when(low.rlike("spleen|marrow|fever|visceral"), "visceral").when(low.rlike("skin|ulcer|papule|plaque|cutan"), "cutaneous")


@query(_PAGES + f""", p AS (SELECT qid, doc_id, page_index, max(score) AS score, any_value(text) AS text FROM h GROUP BY ALL),
a AS (SELECT qid, any_value(k) AS qk FROM (SELECT DISTINCT qid, {_KINDS.format("query")} AS k FROM answer_records WHERE qid IS NOT NULL AND query IS NOT NULL) WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT p.qid, doc_id, page_index, score, round(score + CASE WHEN qk IS NULL OR {_KINDS.format("text")} IS NULL THEN 0 WHEN qk = {_KINDS.format("text")} THEN 0.005 ELSE -0.003 END, 9) AS adjusted FROM p LEFT JOIN a USING (qid))
SELECT qid, doc_id, page_index, adjusted, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, page_index) AS rank, row_number() OVER (PARTITION BY qid ORDER BY adjusted DESC, doc_id, page_index) AS new_rank FROM s""")
def kind_rerank(spark: SparkSession, d: str) -> DataFrame:
    """RT25, SC20, WN20: small bonus for pages of the query's kind, small malus for others, none where either kind is open."""
    p = _pages(spark, d).groupBy("qid", "doc_id", "page_index").agg(F.max("score").alias("score"), F.max("text").alias("text"))
    a = table(spark, d, "answer_records").where("qid is not null and query is not null").select("qid", _kind(F.col("query")).alias("qk")).where("qk is not null").distinct()
    a = a.groupBy("qid").agg(F.max("qk").alias("qk"), F.count("*").alias("n")).where("n = 1").drop("n")
    kind = _kind(F.col("text"))
    shift = F.when(F.col("qk").isNull() | kind.isNull(), 0.0).when(F.col("qk") == kind, 0.005).otherwise(-0.003)
    s = p.join(a, "qid", "left").withColumn("adjusted", F.round(F.col("score") + shift, 9))
    order = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "doc_id", "page_index"))
    return s.select("qid", "doc_id", "page_index", "adjusted", order("score").alias("rank"), order("adjusted").alias("new_rank"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 32),
w AS (SELECT qid, max(score) FILTER (rank <= 8) < 0.5 AS weak, max(score) AS top FROM r GROUP BY 1)
SELECT qid, count(doc_id) AS kept, CASE WHEN any_value(weak) AND count(doc_id) FILTER (rank > 8 AND score >= 0.3) = 0 THEN 'abstain' WHEN any_value(weak) THEN 'widened' ELSE 'narrow' END AS outcome, round(sum(score), 6) AS mass
FROM r JOIN w USING (qid) WHERE rank <= CASE WHEN weak THEN 32 ELSE 8 END GROUP BY qid""")
def widened_search(spark: SparkSession, d: str) -> DataFrame:
    """RT33, TK4, TK11: eight neighbours, or 32 where the head is weak; a weak list without support in its tail abstains."""
    from caseloom.plans.lists import _dense

    r = _dense(spark, d, 32)
    w = r.groupBy("qid").agg((F.max(F.when(F.col("rank") <= 8, F.col("score"))) < 0.5).alias("weak"))
    k = r.join(w, "qid").where(F.col("rank") <= F.when(F.col("weak"), 32).otherwise(8))
    tail = F.count_if((F.col("rank") > 8) & (F.col("score") >= 0.3))
    weak = F.max("weak")
    return k.groupBy("qid").agg(F.count("*").alias("kept"), F.when(weak & (tail == 0), "abstain").when(weak, "widened").otherwise("narrow").alias("outcome"), F.round(F.sum("score"), 6).alias("mass"))


@query(r"""WITH q AS (SELECT DISTINCT query_id AS qid, list_distinct(list_filter(regexp_split_to_array(lower(ground_truth.diagnosis), '[^\p{L}]+'), lambda w: len(w) > 3)) AS w, lower(ground_truth.diagnosis_type) AS t FROM eval_queries WHERE query_id % 20 = 0 AND ground_truth.diagnosis IS NOT NULL),
e AS (SELECT entry_id, list_name, lower(canonical_name) AS title, list_distinct(list_filter(regexp_split_to_array(lower(canonical_name || ' ' || coalesce(array_to_string(aliases, ' '), '')), '[^\p{L}]+'), lambda w: len(w) > 3)) AS w, lower(type_code) AS t FROM diagnosis_catalog),
x AS (SELECT qid, entry_id, count(*) AS shared FROM (SELECT qid, unnest(w) AS w FROM q) JOIN (SELECT entry_id, unnest(w) AS w FROM e) USING (w) GROUP BY ALL),
s AS (SELECT qid, entry_id, round(shared / sqrt(len(e.w)) + CASE WHEN len(list_filter(q.w, lambda z: contains(e.title, z))) = len(q.w) THEN 0.5 ELSE 0 END + CASE WHEN q.t = e.t THEN 0.25 ELSE 0 END, 9) AS score FROM x JOIN q USING (qid) JOIN e USING (entry_id))
SELECT qid, entry_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, entry_id) AS rank FROM s QUALIFY rank <= 3""")
def overlap_with_bonus(spark: SparkSession, d: str) -> DataFrame:
    """RT24: shared words over the root of the entry's words, with a bonus for a full title match and for the same type."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 3))
    q = table(spark, d, "eval_queries").where("query_id % 20 = 0 and ground_truth.diagnosis is not null")
    q = q.select(F.col("query_id").alias("qid"), words(F.col("ground_truth.diagnosis")).alias("w"), F.lower("ground_truth.diagnosis_type").alias("t")).distinct()
    c = table(spark, d, "diagnosis_catalog")
    e = c.select("entry_id", F.lower("canonical_name").alias("title"), words(F.concat_ws(" ", "canonical_name", F.array_join("aliases", " "))).alias("ew"), F.lower("type_code").alias("et"))
    x = q.select("qid", F.explode("w").alias("word")).join(e.select("entry_id", F.explode("ew").alias("word")), "word").groupBy("qid", "entry_id").agg(F.count("*").alias("shared"))
    full = F.size(F.filter("w", lambda z: F.contains(F.col("title"), z))) == F.size("w")
    score = F.col("shared") / F.sqrt(F.size("ew")) + F.when(full, 0.5).otherwise(0.0) + F.when(F.col("t") == F.col("et"), 0.25).otherwise(0.0)
    s = x.join(q, "qid").join(e, "entry_id").select("qid", "entry_id", F.round(score, 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entry_id"))).where("rank <= 3")


@query("""WITH a AS (SELECT DISTINCT answer_id, coalesce(model_name, '') AS model, top_score AS x FROM answer_records)
SELECT model, count(*) AS n_total, count(x) AS n_used, count(*) - count(x) AS n_missing, round(avg(x), 9) AS mean_skip, round(sum(coalesce(x, 0)) / count(*), 9) AS mean_zero, count(x) < count(*) AS error FROM (SELECT answer_id, model, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x FROM a) GROUP BY model""")
def missing_policies(spark: SparkSession, d: str) -> DataFrame:
    """EV21, AG9, SC51: means that skip missing values or take them as 0, and whether a strict policy fails; NaN and infinities are missing."""
    x = F.col("top_score")
    x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    a = table(spark, d, "answer_records").select("answer_id", F.coalesce("model_name", F.lit("")).alias("model"), "top_score").distinct().withColumn("x", x)
    total, used = F.count("*"), F.count("x")
    return a.groupBy("model").agg(total.alias("n_total"), used.alias("n_used"), (total - used).alias("n_missing"), F.round(F.avg("x"), 9).alias("mean_skip"), F.round(F.sum(F.coalesce("x", F.lit(0.0))) / total, 9).alias("mean_zero"), (used < total).alias("error"))


@query(f"""WITH a AS (SELECT qid, coalesce(model_name, '') AS model, coalesce(generation_mode, '') AS mode, avg(top_score) AS x FROM answer_records WHERE qid IS NOT NULL AND top_score IS NOT NULL GROUP BY ALL),
p AS (SELECT qid, model, x, i, mode, {_UNIT.format("concat_ws('|', 7, i, qid, model, mode)")} AS u FROM a, range(20) t(i)),
o AS (SELECT qid, model, i, arg_min(x, struct_pack(u := u, m := mode)) AS x FROM p GROUP BY ALL),
b AS (SELECT model, i, sum(-ln(greatest({_UNIT.format("concat_ws('|', 42, i, qid)")}, 1e-12)) * x) / sum(-ln(greatest({_UNIT.format("concat_ws('|', 42, i, qid)")}, 1e-12))) AS m FROM o GROUP BY ALL),
l AS (SELECT model, list_sort(list(m)) AS m FROM b GROUP BY 1)
SELECT model, round(m[1 + CAST(floor(20 * 0.025) AS INT)], 6) AS low, round(m[1 + greatest(0, CAST(floor(20 * 0.975) AS INT) - 1)], 6) AS high FROM l""")
def hierarchical_ci(spark: SparkSession, d: str) -> DataFrame:
    """EV24: cases are weighted, and of the runs of a case one is drawn, in each replicate."""
    a = table(spark, d, "answer_records").where("qid is not null and top_score is not null")
    a = a.groupBy("qid", F.coalesce("model_name", F.lit("")).alias("model"), F.coalesce("generation_mode", F.lit("")).alias("mode")).agg(F.avg("top_score").alias("x"))
    ci = E.confidence_interval(E.hierarchical_means(a, "model", "qid", "mode", "x", 20), "model")
    return ci.select("model", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH a AS (SELECT answer_id, coalesce(generation_mode, '') AS g, max(CAST(coalesce(answer_format_valid, false) AS INT)) AS s FROM answer_records GROUP BY ALL),
b AS (SELECT g, i, sum(-ln(greatest({_UNIT.format("concat_ws('|', 42, i, answer_id)")}, 1e-12)) * s) / sum(-ln(greatest({_UNIT.format("concat_ws('|', 42, i, answer_id)")}, 1e-12))) AS m FROM a, range(20) t(i) GROUP BY ALL),
l AS (SELECT g, list_sort(list(m)) AS m FROM b GROUP BY 1), n AS (SELECT g, count(*) AS n, avg(s) AS share FROM a GROUP BY 1)
SELECT g, n, round(share, 9) AS share, round(m[1 + CAST(floor(20 * 0.025) AS INT)], 6) AS low, round(m[1 + greatest(0, CAST(floor(20 * 0.975) AS INT) - 1)], 6) AS high FROM l JOIN n USING (g)""")
def proportion_ci(spark: SparkSession, d: str) -> DataFrame:
    """EV27: share of valid formats with its interval, by mode."""
    a = table(spark, d, "answer_records").groupBy("answer_id", F.coalesce("generation_mode", F.lit("")).alias("g")).agg(F.max(F.coalesce("answer_format_valid", F.lit(False)).cast("double")).alias("s"))
    ci = E.confidence_interval(E.bootstrap_means(a, "g", "answer_id", "s", 20), "g")
    n = a.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("share"))
    return n.join(ci, "g").select("g", "n", "share", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_ARMS = """WITH m AS (SELECT qid, coalesce(query_type, '') AS kind, coalesce(generation_mode, '') AS mode, avg(CAST(coalesce(answer_format_valid, false) AS INT)) AS valid, avg(top_score) AS score FROM answer_records WHERE qid IS NOT NULL GROUP BY ALL),
j AS (SELECT a.qid, a.kind, a.valid - b.valid AS d, a.score AS score_a, b.score AS score_b FROM m a JOIN m b ON a.qid = b.qid AND a.kind = b.kind AND a.mode = 'rag_prompt' AND b.mode = 'norag_prompt')"""


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """Means of a question with and without retrieval, beside each other."""
    m = table(spark, d, "answer_records").where("qid is not null").groupBy("qid", F.coalesce("query_type", F.lit("")).alias("kind"), F.coalesce("generation_mode", F.lit("")).alias("mode"))
    m = m.agg(F.avg(F.coalesce("answer_format_valid", F.lit(False)).cast("int")).alias("valid"), F.avg("top_score").alias("score"))
    a, b = (m.where(F.col("mode") == x).select("qid", "kind", F.col("valid").alias(f"valid_{s}"), F.col("score").alias(f"score_{s}")) for x, s in (("rag_prompt", "a"), ("norag_prompt", "b")))
    return a.join(b, ["qid", "kind"]).withColumn("d", F.col("valid_a") - F.col("valid_b"))


@query(_ARMS + """ SELECT kind, count(*) AS pairs, round(avg(d), 9) AS mean_delta, round(stddev_samp(d), 9) AS sd, count_if(d > 1e-9) AS wins, count_if(d < -1e-9) AS losses, count_if(abs(d) <= 1e-9) AS ties, round(100 * avg(d) / nullif(avg(abs(d)), 0), 6) AS signed_percent FROM j GROUP BY kind""")
def grouped_deltas(spark: SparkSession, d: str) -> DataFrame:
    """EV25, EV35, MV17: paired deltas of two arms by kind of query, with wins, losses and ties."""
    x, far = F.col("d"), 1e-9
    return _arms(spark, d).groupBy("kind").agg(
        F.count("*").alias("pairs"), F.round(F.avg(x), 9).alias("mean_delta"), F.round(F.stddev_samp(x), 9).alias("sd"), F.count_if(x > far).alias("wins"), F.count_if(x < -far).alias("losses"),
        F.count_if(F.abs(x) <= far).alias("ties"), F.round(F.try_divide(100 * F.avg(x), F.avg(F.abs(x))), 6).alias("signed_percent"),
    )


@query(_ARMS + """, s AS (SELECT qid, retrieval_support_status AS st, count(*) AS n FROM answer_records WHERE qid IS NOT NULL AND generation_mode = 'rag_prompt' GROUP BY ALL),
o AS (SELECT qid, arg_max(coalesce(st, ''), struct_pack(n := n, s := coalesce(st, ''))) AS st FROM s GROUP BY 1)
SELECT kind, st, count(*) AS losers, round(avg(score_a), 9) AS score_with, round(avg(score_b), 9) AS score_without FROM j JOIN o USING (qid) WHERE d < -1e-9 GROUP BY kind, st""")
def loser_modes(spark: SparkSession, d: str) -> DataFrame:
    """EV36, JN9, EV34: questions that lose with retrieval, by kind and support, both arms side by side."""
    s = table(spark, d, "answer_records").where("qid is not null and generation_mode = 'rag_prompt'").groupBy("qid", F.coalesce("retrieval_support_status", F.lit("")).alias("st")).agg(F.count("*").alias("n"))
    o = s.groupBy("qid").agg(F.max_by("st", F.struct("n", "st")).alias("st"))
    lost = _arms(spark, d).where(F.col("d") < -1e-9).join(o, "qid")
    return lost.groupBy("kind", "st").agg(F.count("*").alias("losers"), F.round(F.avg("score_a"), 9).alias("score_with"), F.round(F.avg("score_b"), 9).alias("score_without"))


@query("""WITH p AS (SELECT doc_id, page_index, list_sort(list_distinct(flatten(list(keywords)))) AS points, lower(any_value(text_excerpt)) AS t FROM page_hits WHERE doc_id IS NOT NULL AND page_index IS NOT NULL AND keywords IS NOT NULL AND text_excerpt IS NOT NULL GROUP BY ALL),
x AS (SELECT doc_id, page_index, points, list_filter(range(1, len(points) + 2), lambda i: i > len(points) OR contains(t, lower(points[i]))) AS given FROM p)
SELECT doc_id, page_index, CAST(len(points) AS INT) AS total, CAST(len(list_filter(given, lambda i: i <= len(points))) AS INT) AS matched, round(CASE WHEN len(points) = 0 THEN 0 ELSE len(list_filter(given, lambda i: i <= len(points))) / len(points) END, 9) AS recall,
array_to_string(list_filter(points, lambda w: NOT contains(t, lower(w))), '|') AS unmatched FROM x JOIN p USING (doc_id, page_index, points)""")
def matched_recall(spark: SparkSession, d: str) -> DataFrame:
    """EV31: recall of the points whose numbers are given; numbers outside the list do not count.

    The points are the keywords of a page, the numbers those that its text holds and one beyond the list.
    """
    h = table(spark, d, "page_hits").where("doc_id is not null and page_index is not null and keywords is not null and text_excerpt is not null")
    p = h.groupBy("doc_id", "page_index").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords")))).alias("points"), F.lower(F.max("text_excerpt")).alias("t"))
    given = F.filter(F.sequence(F.lit(1), F.size("points") + 1), lambda i: (i > F.size("points")) | F.contains(F.col("t"), F.lower(F.get("points", i - 1))))
    r = E.recall_of_indices(p.withColumn("given", given), "points", "given")
    return r.select("doc_id", "page_index", "total", "matched", F.round("recall", 9).alias("recall"), F.array_join("unmatched", "|").alias("unmatched"))


@query("""WITH h AS (SELECT DISTINCT question_id AS qid, doc_id || ':' || page_index AS doc_id, rank, coalesce(page_kind, '') = 'mixed' AS rel FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL AND rank IS NOT NULL),
l AS (SELECT qid, doc_id, min(rank) AS rank, bool_or(rel) AS rel FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, doc_id) AS place FROM l),
c AS (SELECT *, count_if(rel) OVER (PARTITION BY qid ORDER BY place ROWS UNBOUNDED PRECEDING) AS seen FROM r WHERE place <= 5),
q AS (SELECT qid, count_if(rel) / 5 AS p5, coalesce(max(CASE WHEN rel THEN 1.0 / place END), 0) AS mrr5, coalesce(sum(CASE WHEN rel THEN seen / place END) / nullif(count_if(rel), 0), 0) AS ap_hits FROM c GROUP BY 1)
SELECT 'macro' AS level, count(*) AS queries, round(avg(p5), 9) AS precision_5, round(avg(mrr5), 9) AS mrr_5, round(avg(ap_hits), 9) AS map_hits FROM q""")
def variant_metrics(spark: SparkSession, d: str) -> DataFrame:
    """EV11, AG37: precision over k, MRR within k, average precision over the hits found, and their macro averages."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and rank is not null")
    rel = F.coalesce(F.col("page_kind") == "mixed", F.lit(False))
    l = h.groupBy(F.col("question_id").alias("qid"), F.concat("doc_id", F.lit(":"), F.col("page_index").cast("string")).alias("doc_id")).agg(F.min("rank").alias("rank"), F.max(rel).alias("rel"))  # noqa: E741
    w = Window.partitionBy("qid").orderBy("rank", "doc_id")
    c = l.withColumn("place", F.row_number().over(w)).where("place <= 5").withColumn("seen", F.count_if("rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = lambda x: F.when(F.col("rel"), x)
    q = c.groupBy("qid").agg(
        (F.count_if("rel") / 5).alias("p5"), F.coalesce(F.max(hit(1.0 / F.col("place"))), F.lit(0.0)).alias("mrr5"), F.coalesce(F.try_divide(F.sum(hit(F.col("seen") / F.col("place"))), F.count_if("rel")), F.lit(0.0)).alias("ap_hits")
    )
    return q.agg(F.count("*").alias("queries"), F.round(F.avg("p5"), 9).alias("precision_5"), F.round(F.avg("mrr5"), 9).alias("mrr_5"), F.round(F.avg("ap_hits"), 9).alias("map_hits")).withColumn("level", F.lit("macro"))


@query("""WITH a AS (SELECT coalesce(model_name, '') AS model, coalesce(query_type, '') AS kind, max(top_score) AS best, avg(top_score) AS mean FROM answer_records WHERE top_score IS NOT NULL GROUP BY ALL),
r AS (SELECT kind, model, round(mean, 9) AS mean, rank() OVER (PARTITION BY kind ORDER BY round(mean, 9) DESC) AS place FROM a)
SELECT model, round(max(mean) FILTER (place = 1), 9) AS best_mean, min(place) AS best_place, count_if(place = 1) AS first_places, max(place) AS worst_place FROM r GROUP BY model""")
def rank_min(spark: SparkSession, d: str) -> DataFrame:
    """WN2, EV18, EV19: competition ranks (equal values share the smallest), and how often a model is first."""
    a = table(spark, d, "answer_records").where("top_score is not null").groupBy(F.coalesce("model_name", F.lit("")).alias("model"), F.coalesce("query_type", F.lit("")).alias("kind")).agg(F.round(F.avg("top_score"), 9).alias("mean"))
    r = a.withColumn("place", F.rank().over(Window.partitionBy("kind").orderBy(F.desc("mean"))))
    return r.groupBy("model").agg(F.round(F.max(F.when(F.col("place") == 1, F.col("mean"))), 9).alias("best_mean"), F.min("place").alias("best_place"), F.count_if(F.col("place") == 1).alias("first_places"), F.max("place").alias("worst_place"))


_MEASURES = {"score": "top_score", "retries": "format_retry_count", "contexts": "prompt_context_count"}


@query("""WITH u AS (SELECT coalesce(model_name, '') AS model, 'score' AS metric, CAST(top_score AS DOUBLE) AS v FROM answer_records UNION ALL SELECT coalesce(model_name, ''), 'retries', format_retry_count FROM answer_records UNION ALL SELECT coalesce(model_name, ''), 'contexts', prompt_context_count FROM answer_records),
m AS (SELECT metric, model, round(avg(v), 6) AS v FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, model) AS place FROM m)
SELECT metric, max(model) FILTER (place = 1) AS first, max(v) FILTER (place = 1) AS v1, max(model) FILTER (place = 2) AS second, max(v) FILTER (place = 2) AS v2, max(model) FILTER (place = 3) AS third, max(v) FILTER (place = 3) AS v3 FROM r GROUP BY metric""")
def metric_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """AG29, AG30: measures by model, pivoted to the first, second and third of each measure."""
    m = table(spark, d, "answer_records").groupBy(F.coalesce("model_name", F.lit("")).alias("model")).agg(*[F.round(F.avg(c), 6).alias(n) for n, c in _MEASURES.items()])
    r = m.unpivot("model", list(_MEASURES), "metric", "v").withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("v"), "model"))).where("place <= 3")
    p = r.groupBy("metric").pivot("place", [1, 2, 3]).agg(F.first("model").alias("model"), F.first("v").alias("v"))  # one row in each cell
    return p.select("metric", F.col("1_model").alias("first"), F.col("1_v").alias("v1"), F.col("2_model").alias("second"), F.col("2_v").alias("v2"), F.col("3_model").alias("third"), F.col("3_v").alias("v3"))


@query("""WITH q AS (SELECT question_id AS qid, count(DISTINCT doc_id || ':' || page_index) AS n FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL GROUP BY 1),
b AS (SELECT CASE WHEN n <= 0 THEN 0 WHEN n <= 5 THEN 5 WHEN n <= 10 THEN 10 WHEN n <= 20 THEN 20 WHEN n <= 50 THEN 50 WHEN n <= 100 THEN 100 ELSE 500 END AS up_to, n FROM q)
SELECT CAST(up_to AS INT) AS up_to, count(*) AS queries, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM b GROUP BY up_to""")
def relevant_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AG18, AG22, AG24: queries by how many pages they have, with least, most and mean of each bin."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null")
    q = h.groupBy(F.col("question_id").alias("qid")).agg(F.count_distinct(F.concat_ws(":", "doc_id", F.col("page_index").cast("string"))).alias("n"))
    n, up = F.col("n"), F.lit(500)
    for bound in (100, 50, 20, 10, 5, 0):
        up = F.when(n <= bound, bound).otherwise(up)
    return q.groupBy(up.alias("up_to")).agg(F.count("*").alias("queries"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("""WITH k AS (SELECT 'article' AS kind, article_id AS key, row_id AS r FROM leishmaniasis_matched_cases WHERE article_id IS NOT NULL UNION ALL SELECT 'case', case_id, row_id FROM leishmaniasis_matched_cases WHERE case_id IS NOT NULL
UNION ALL SELECT 'both', article_id || '/' || case_id, row_id FROM leishmaniasis_matched_cases WHERE article_id IS NOT NULL AND case_id IS NOT NULL),
c AS (SELECT kind, key, count(*) AS n, count(DISTINCT r) AS records FROM k GROUP BY ALL HAVING count(*) > 1)
SELECT kind, key, n, records, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS place FROM c QUALIFY place <= 5""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """AG23: repeated values of three keys, the five most frequent of each."""
    t = table(spark, d, "leishmaniasis_matched_cases")
    key = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in (("article", F.col("article_id")), ("case", F.col("case_id")), ("both", F.concat("article_id", F.lit("/"), "case_id")))]))
    k = t.select("row_id", key.alias("x")).select("x.kind", "x.key", "row_id").where("key is not null")
    c = k.groupBy("kind", "key").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("records")).where("n > 1")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))).where("place <= 5")


@query("""WITH c AS (SELECT DISTINCT q.case_id, split_part(q.case_id, '_', 1) AS article, lower(trim(q.split)) AS s FROM eval_queries q WHERE q.case_id IS NOT NULL AND q.split IS NOT NULL),
u AS (SELECT 'case' AS kind, case_id AS key, s FROM c UNION SELECT 'article', article, s FROM c),
k AS (SELECT kind, key, count(DISTINCT s) AS splits, bool_or(s = 'test') AS in_test, bool_or(s = 'train') AS in_train FROM u GROUP BY ALL)
SELECT kind, count(*) AS keys, count_if(splits > 1) AS shared, count_if(in_test AND in_train) AS train_and_test, count_if(in_test AND splits = 1) AS test_only FROM k GROUP BY kind""")
def split_overlap_keys(spark: SparkSession, d: str) -> DataFrame:
    """EV44, AG27: cases and articles that stand in several splits, in train and test, or in test only."""
    c = table(spark, d, "eval_queries").where("case_id is not null and split is not null").select("case_id", F.split("case_id", "_")[0].alias("article"), F.lower(F.trim("split")).alias("s"))
    u = c.select(F.lit("case").alias("kind"), F.col("case_id").alias("key"), "s").union(c.select(F.lit("article"), "article", "s"))
    k = u.groupBy("kind", "key").agg(F.count_distinct("s").alias("splits"), F.max(F.col("s") == "test").alias("in_test"), F.max(F.col("s") == "train").alias("in_train"))
    return k.groupBy("kind").agg(F.count("*").alias("keys"), F.count_if(F.expr("splits > 1")).alias("shared"), F.count_if(F.expr("in_test and in_train")).alias("train_and_test"), F.count_if(F.expr("in_test and splits = 1")).alias("test_only"))


_STRATUM = "coalesce(lower(trim(leish_type)), '')"


@query(f"""WITH r AS (SELECT row_id, {_STRATUM} AS s0 FROM leishmaniasis_matched_cases WHERE row_id IS NOT NULL GROUP BY ALL), n AS (SELECT s0, count(*) AS n FROM r GROUP BY 1),
m AS (SELECT row_id, CASE WHEN n < 30 THEN 'merged' ELSE s0 END AS stratum FROM r JOIN n USING (s0))
SELECT row_id, stratum, CAST((row_number() OVER (PARTITION BY stratum, substr(md5('f' || row_id), 1, 1) ORDER BY md5('f' || row_id), row_id) - 1 + ascii(md5('f' || row_id))) % 5 AS INT) AS fold FROM m""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """SG4, SG21: five folds that share out every stratum evenly; strata of fewer than 30 rows are merged.

    A stratum is dealt in sixteen hash parts that begin at different folds, so none is sorted in one task.
    """
    r = table(spark, d, "leishmaniasis_matched_cases").where("row_id is not null").select("row_id", F.coalesce(F.lower(F.trim("leish_type")), F.lit("")).alias("s0")).distinct()
    return P.stratified_folds(r, "row_id", "s0", 5, 30)


@query("""WITH r AS (SELECT DISTINCT row_id, coalesce(article_id, '') AS article, coalesce(lower(trim(leish_type)), '') AS t FROM leishmaniasis_matched_cases WHERE row_id IS NOT NULL),
g AS (SELECT t, article, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT t, article, n, sum(n) OVER (PARTITION BY t ORDER BY md5(article), article ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY t) AS total FROM g)
SELECT t, count(*) AS groups, sum(n) AS records, count_if(before < 0.1 * total) AS test_groups, coalesce(sum(n) FILTER (before < 0.1 * total), 0) AS test_records FROM s GROUP BY t""")
def quota_fill(spark: SparkSession, d: str) -> DataFrame:
    """WN23: groups in hash order go to test until a tenth of the records of their type is reached."""
    r = table(spark, d, "leishmaniasis_matched_cases").where("row_id is not null").select("row_id", F.coalesce("article_id", F.lit("")).alias("article"), F.coalesce(F.lower(F.trim("leish_type")), F.lit("")).alias("t")).distinct()
    g = r.groupBy("t", "article").agg(F.count("*").alias("n"))
    w = Window.partitionBy("t")
    s = g.withColumn("before", F.sum("n").over(w.orderBy(F.md5("article"), "article").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(w))
    test = F.col("before") < 0.1 * F.col("total")
    return s.groupBy("t").agg(F.count("*").alias("groups"), F.sum("n").alias("records"), F.count_if(test).alias("test_groups"), F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias("test_records"))


@query(f"""WITH l AS (SELECT case_id, coalesce(lower(trim(diagnosis_type)), '') AS e FROM diagnosis_labels WHERE case_id IS NOT NULL GROUP BY ALL), f AS (SELECT e, count(*) AS n FROM l GROUP BY 1),
c AS (SELECT case_id, string_agg(e, '+' ORDER BY e) AS signature, min(n) < 5 AS rare FROM l JOIN f USING (e) GROUP BY 1), z AS (SELECT signature, count(*) AS cases FROM c GROUP BY 1)
SELECT case_id, signature, CASE WHEN rare OR cases < 5 THEN 'train' WHEN {_UNIT.format("concat_ws('|', 3, case_id)")} < 0.2 THEN 'test' ELSE 'train' END AS split FROM c JOIN z USING (signature)""")
def rare_to_train(spark: SparkSession, d: str) -> DataFrame:
    """SG3, SG14: cases by the set of their kinds; those with a rare kind or a rare set go to train, a fifth of the others to test."""
    l = table(spark, d, "diagnosis_labels").where("case_id is not null").select("case_id", F.coalesce(F.lower(F.trim("diagnosis_type")), F.lit("")).alias("e")).distinct()  # noqa: E741
    f = l.groupBy("e").agg(F.count("*").alias("n"))
    c = l.join(f, "e").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("e")), "+").alias("signature"), (F.min("n") < 5).alias("rare"))
    z = c.groupBy("signature").agg(F.count("*").alias("cases"))
    test = E.hash_unit(F.lit(3), F.col("case_id")) < 0.2
    return c.join(z, "signature").select("case_id", "signature", F.when(F.col("rare") | (F.col("cases") < 5), "train").when(test, "test").otherwise("train").alias("split"))


@query("""WITH r AS (SELECT answer_id, coalesce(nullif(trim(query_type), ''), 'none') AS g FROM answer_records GROUP BY ALL), o AS (SELECT answer_id, g, md5('m' || answer_id) AS h FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h, answer_id) AS place FROM o)
SELECT g, count(*) AS have, count_if(place <= 100) AS by_quota, count_if(place > 100 AND place <= 150) AS pool FROM k GROUP BY g""")
def soft_quota(spark: SparkSession, d: str) -> DataFrame:
    """SG20: up to a hundred of each kind, then a pool of the next fifty to top the mix up from."""
    r = table(spark, d, "answer_records").select("answer_id", F.coalesce(F.when(F.trim("query_type") != "", F.trim("query_type")), F.lit("none")).alias("g")).distinct()
    h = F.md5(F.concat(F.lit("m"), F.col("answer_id").cast("string")))
    have = r.groupBy("g").agg(F.count("*").alias("have"))
    k = r.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(h, "answer_id"))).where("place <= 150")
    return k.groupBy("g").agg(F.count_if(F.expr("place <= 100")).alias("by_quota"), F.count_if(F.expr("place > 100")).alias("pool")).join(have, "g").select("g", "have", "by_quota", "pool")
