"""Sentences, sections, manifests, audits and keyed merges over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import ranking as K
from caseloom.plans.lists import _DENSE
from caseloom.plans.lists import _dense as dense
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


_CUES = ["biopsy", "culture", "parasites", "spleen", "ulcer", "travel"]
_SENTENCES = """WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
e AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s),
c AS (SELECT doc_id, i, x, len(regexp_split_to_array(x, '\\s+')) AS words, """ + " + ".join(f"CAST(contains(lower(x), '{w}') AS INT)" for w in _CUES) + " AS cues FROM e)"


def _cued(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of documents with their words and how many cue words they hold."""
    e = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "x")).withColumn("i", (F.col("p") + 1).cast("bigint"))
    cues = sum((F.contains(F.lower("x"), F.lit(w)).cast("int") for w in _CUES), F.lit(0))
    return e.select("doc_id", "i", "x", F.size(F.split("x", r"\s+")).cast("bigint").alias("words"), cues.alias("cues"))


@query(_SENTENCES + """, o AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY cues DESC, i ROWS UNBOUNDED PRECEDING) AS used FROM c WHERE cues > 0)
SELECT doc_id, count(*) AS kept, CAST(sum(words) AS BIGINT) AS words, string_agg(i::VARCHAR, ',' ORDER BY i) AS sentences FROM o WHERE used <= 150 GROUP BY 1""")
def cue_sentences(spark: SparkSession, d: str) -> DataFrame:
    """SC10, SC43: sentences with cue words, the richest first, within 150 words, in their own order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("cues"), "i").rowsBetween(Window.unboundedPreceding, 0)
    o = _cued(spark, d).where("cues > 0").withColumn("used", F.sum("words").over(w)).where("used <= 150")
    order = F.transform(F.array_sort(F.collect_list("i")), lambda i: i.cast("string"))
    return o.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("words").alias("words"), F.array_join(order, ",").alias("sentences"))


@query(_SENTENCES + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cues DESC, i) AS place FROM c)
SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (place <= 1) AS short, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (place <= 3) AS medium, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (place <= 6) AS detailed FROM r WHERE place <= 6 GROUP BY 1""")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    """SC44, SC12: summaries of one, three and six sentences, chosen by cues and kept in text order."""
    r = _cued(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cues"), "i"))).where("place <= 6")
    pick = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= n, F.col("i")))), lambda i: i.cast("string")), ",")
    return r.groupBy("doc_id").agg(pick(1).alias("short"), pick(3).alias("medium"), pick(6).alias("detailed"))


@query(r"""WITH q AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(ground_truth.diagnosis), '[^\p{L}]+'), lambda w: len(w) > 3)) AS terms, clinical_context AS t FROM eval_queries WHERE query_id % 20 = 0 AND clinical_context IS NOT NULL AND ground_truth.diagnosis IS NOT NULL GROUP BY ALL),
p AS (SELECT article_id, doc_id, text FROM documents WHERE article_id IS NOT NULL),
a AS (SELECT DISTINCT query_id, terms, regexp_extract(case_id, '^([^_]*)', 1) AS article FROM q JOIN eval_queries USING (query_id) WHERE case_id IS NOT NULL),
s AS (SELECT query_id, terms, doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x)), lambda x: x <> '') AS s FROM a JOIN p ON p.article_id = a.article),
e AS (SELECT query_id, terms, doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS x FROM s),
v AS (SELECT query_id, doc_id, i, lower(x) AS x, len(list_filter(terms, lambda w: contains(lower(x), w))) AS hits FROM e),
d AS (SELECT query_id, x, max(hits) AS hits, min(struct_pack(a := doc_id, b := i)) AS k FROM v WHERE hits > 0 GROUP BY ALL)
SELECT query_id, k.a AS doc_id, k.b AS i, CAST(hits AS INT) AS hits FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, k) <= 20""")
def spans_of_question(spark: SparkSession, d: str) -> DataFrame:
    """SC47, SC46: sentences of the query's article by how many words of its diagnosis they hold, equal ones once, twenty at most."""
    terms = F.array_distinct(F.filter(F.split(F.lower("ground_truth.diagnosis"), r"[^\p{L}]+"), lambda w: F.length(w) > 3))
    q = table(spark, d, "eval_queries").where("query_id % 20 = 0 and clinical_context is not null and ground_truth.diagnosis is not null and case_id is not null")
    a = q.select("query_id", terms.alias("terms"), F.split("case_id", "_")[0].alias("article_id")).distinct()
    s = a.join(table(spark, d, "documents").select("article_id", "doc_id", "text"), "article_id")
    e = s.select("query_id", "terms", "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "x")).withColumn("i", (F.col("p") + 1).cast("bigint")).withColumn("x", F.lower("x"))
    v = e.withColumn("hits", F.size(F.filter("terms", lambda w: F.contains(F.col("x"), w)))).where("hits > 0")
    one = v.groupBy("query_id", "x").agg(F.max("hits").alias("hits"), F.min(F.struct("doc_id", "i")).alias("k"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "k"))
    return one.withColumn("place", place).where("place <= 20").select("query_id", "k.doc_id", "k.i", "hits")


@query(r"""WITH a AS (SELECT DISTINCT answer_id, query, answer FROM answer_records WHERE answer IS NOT NULL),
b AS (SELECT answer_id, trim(regexp_replace(CASE WHEN query IS NOT NULL AND query <> '' AND starts_with(answer, query) THEN substr(answer, len(query) + 1) ELSE answer END, '(?is)^.*final answer\s*:\s*', '')) AS t FROM a)
SELECT answer_id, len(t) AS chars, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(t), '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> ''))), '|') AS sentences FROM b""")
def answer_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """SC39: an answer without its query in front, from the last "final answer" on, its sentences once each."""
    a = table(spark, d, "answer_records").where("answer is not null").select("answer_id", "query", "answer").distinct()
    bare = F.when(F.col("query").isNotNull() & (F.col("query") != "") & F.startswith("answer", F.col("query")), F.expr("substring(answer, length(query) + 1)")).otherwise(F.col("answer"))
    t = T.trimmed(F.regexp_replace(bare, r"(?isu)^.*final answer[ \t\n\f\r]*:[ \t\n\f\r]*", ""))
    parts = F.filter(F.transform(F.split(F.lower("t"), r"[.!?\n]+"), T.trimmed), lambda x: x != "")
    return a.select("answer_id", t.alias("t")).select("answer_id", F.length("t").cast("bigint").alias("chars"), F.array_join(F.array_sort(F.array_distinct(parts)), "|").alias("sentences"))


_TEMPLATES = [("discussion", 1, "What does the discussion conclude?"), ("case_presentation", 1, "How did the patient present?"), ("case_presentation", 2, "Which findings were recorded?"), ("results", 1, "What was found?"), ("methods", 1, "How was it studied?")]


@query("WITH t(section, k, question) AS (VALUES " + ", ".join(f"('{s}', {k}, '{q}')" for s, k, q in _TEMPLATES) + """),
x AS (SELECT doc_id, lower(trim(section)) AS section, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda y: trim(y)), lambda y: y <> '') AS s FROM documents WHERE section IS NOT NULL)
SELECT doc_id, section, k, question, s[k] AS answer FROM x JOIN t USING (section) WHERE len(s) >= k""")
def template_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SC45: questions from a table of templates by kind of section, answered by its leading sentences."""
    t = spark.createDataFrame(_TEMPLATES, "section string, k int, question string")
    x = table(spark, d, "documents").where("section is not null").select("doc_id", F.lower(F.trim("section")).alias("section"), T.sentences(F.col("text")).alias("s"))
    return x.join(t, "section").where(F.size("s") >= F.col("k")).select("doc_id", "section", "k", "question", F.get("s", F.col("k") - 1).alias("answer"))


@query("""WITH q AS (SELECT DISTINCT query_id, coalesce(question, '') AS a, coalesce(clinical_context, '') AS b, coalesce(ground_truth.diagnosis, '') AS c FROM eval_queries),
f AS (SELECT *, least(len(a), 80) AS ra, least(len(b), 300) AS rb, least(len(c), 40) AS rc FROM q), g AS (SELECT *, 500 - ra - rb - rc AS free FROM f),
h AS (SELECT *, least(free, len(b) - rb) AS xb FROM g), i AS (SELECT *, least(free - xb, len(a) - ra) AS xa FROM h)
SELECT query_id, 'Question: ' || substr(a, 1, ra + xa) || chr(10) || 'Context: ' || substr(b, 1, rb + xb) || chr(10) || 'Diagnosis: ' || substr(c, 1, rc + least(free - xb - xa, len(c) - rc)) AS prompt FROM i""")
def composed_sections(spark: SparkSession, d: str) -> DataFrame:
    """SC37, SC50: three sections within 500 characters; each has a reserve, what is left goes to the context, then the question, then the rest."""
    q = table(spark, d, "eval_queries").select("query_id", *[F.coalesce(c, F.lit("")).alias(n) for n, c in (("a", "question"), ("b", "clinical_context"), ("c", "ground_truth.diagnosis"))]).distinct()
    size = {n: F.length(n) for n in "abc"}
    kept = {n: F.least(size[n], F.lit(r)) for n, r in (("a", 80), ("b", 300), ("c", 40))}
    free = F.lit(500) - kept["a"] - kept["b"] - kept["c"]
    more_b = F.least(free, size["b"] - kept["b"])
    more_a = F.least(free - more_b, size["a"] - kept["a"])
    more_c = F.least(free - more_b - more_a, size["c"] - kept["c"])
    cut = lambda n, more: F.substring(n, F.lit(1), kept[n] + more)
    return q.select("query_id", F.concat(F.lit("Question: "), cut("a", more_a), F.lit("\nContext: "), cut("b", more_b), F.lit("\nDiagnosis: "), cut("c", more_c)).alias("prompt"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.{0,199}[.!?])(\s|$)', 1) AS a, regexp_extract(text, '(?s)^(.{1,200})\s', 1) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(text) <= 200 THEN text WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE substr(text, 1, 200) END AS head FROM t""")
def sentence_safe_trim(spark: SparkSession, d: str) -> DataFrame:
    """SC33: at most 200 characters, cut behind the last whole sentence, else the last whole word."""
    a, b = F.regexp_extract("text", r"(?s)^(.{0,199}[.!?])(\s|$)", 1), F.regexp_extract("text", r"(?s)^(.{1,200})\s", 1)
    head = F.when(F.length("text") <= 200, F.col("text")).when(a != "", a).when(b != "", b).otherwise(F.substring("text", 1, 200))
    return table(spark, d, "documents").where("text is not null").select("doc_id", head.alias("head"))


@query("""WITH l AS (SELECT DISTINCT label_id, case_id, coalesce(lower(trim(diagnosis_type)), '') AS t, species FROM diagnosis_labels WHERE case_id IS NOT NULL)
SELECT case_id, count(*) AS labels, count_if(t = 'cl') AS cl, count_if(t = 'vl') AS vl, count_if(t = 'mcl') AS mcl, count_if(t NOT IN ('cl', 'vl', 'mcl')) AS other, count(DISTINCT species) AS species FROM l GROUP BY 1""")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    """SG10: labels of each case, counted by type in one pivot."""
    l = table(spark, d, "diagnosis_labels").where("case_id is not null").select("label_id", "case_id", F.coalesce(F.lower(F.trim("diagnosis_type")), F.lit("")).alias("t"), "species").distinct()  # noqa: E741
    kind = F.when(F.col("t").isin("cl", "vl", "mcl"), F.col("t")).otherwise("other")
    p = l.withColumn("k", kind).groupBy("case_id").pivot("k", ["cl", "vl", "mcl", "other"]).count().fillna(0)
    return p.join(l.groupBy("case_id").agg(F.count("*").alias("labels"), F.count_distinct("species").alias("species")), "case_id").select("case_id", "labels", "cl", "vl", "mcl", "other", "species")


@query(r"""WITH l AS (SELECT DISTINCT case_id, diagnosis, species FROM diagnosis_labels WHERE case_id IS NOT NULL),
e AS (SELECT 'case:' || case_id AS s, 'has_diagnosis' AS p, 'diagnosis:' || trim(regexp_replace(lower(diagnosis), '[^a-z0-9]+', '_', 'g'), '_') AS o FROM l WHERE diagnosis IS NOT NULL
UNION SELECT 'case:' || case_id, 'has_species', 'species:' || trim(regexp_replace(lower(species), '[^a-z0-9]+', '_', 'g'), '_') FROM l WHERE species IS NOT NULL)
SELECT s AS subject, p AS predicate, o AS object, s || chr(9) || p || chr(9) || o AS line FROM e""")
def graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """SG13, IO29, SC31: edges with ids made from names, and their tab-separated lines."""
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    l = table(spark, d, "diagnosis_labels").where("case_id is not null")  # noqa: E741
    edges = [l.where(F.col(c).isNotNull()).select(F.concat(F.lit("case:"), "case_id").alias("subject"), F.lit(f"has_{c}").alias("predicate"), F.concat(F.lit(f"{c}:"), slug(c)).alias("object")) for c in ("diagnosis", "species")]
    return edges[0].union(edges[1]).distinct().withColumn("line", F.concat_ws("\t", "subject", "predicate", "object"))


@query("""WITH q AS (SELECT DISTINCT query_id, case_id, query_type FROM eval_queries WHERE case_id IS NOT NULL AND query_type IS NOT NULL),
n AS (SELECT query_id, case_id || '::' || query_type AS qid, case_id || '_q' || lpad((row_number() OVER (PARTITION BY case_id ORDER BY query_type, query_id))::VARCHAR, 3, '0') AS manifest_id FROM q),
p AS (SELECT DISTINCT question_id AS qid, image_path FROM page_hits WHERE image_path IS NOT NULL AND question_id IS NOT NULL),
r AS (SELECT manifest_id, qid, image_path, row_number() OVER (PARTITION BY manifest_id ORDER BY image_path) AS k FROM n JOIN p USING (qid))
SELECT manifest_id, any_value(n.qid) AS qid, coalesce(string_agg(image_path, '|' ORDER BY image_path) FILTER (k <= 3), '') AS evidence FROM n LEFT JOIN r USING (manifest_id) GROUP BY manifest_id""")
def question_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SG16, SG17: questions of a case numbered through, with their evidence pages once each, three at most."""
    q = table(spark, d, "eval_queries").where("case_id is not null and query_type is not null").select("query_id", "case_id", "query_type").distinct()
    k = F.row_number().over(Window.partitionBy("case_id").orderBy("query_type", "query_id")).cast("string")
    n = q.select(F.concat("case_id", F.lit("::"), "query_type").alias("qid"), F.concat("case_id", F.lit("_q"), F.lpad(k, 3, "0")).alias("manifest_id"))
    p = table(spark, d, "page_hits").where("image_path is not null and question_id is not null").groupBy(F.col("question_id").alias("qid")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("image_path")), 1, 3), "|").alias("evidence"))
    return n.join(p, "qid", "left").select("manifest_id", "qid", F.coalesce("evidence", F.lit("")).alias("evidence"))


@query("""WITH q AS (SELECT query_id, md5(concat_ws('|', coalesce(question, ''), coalesce(ground_truth.diagnosis, ''), coalesce(array_to_string(query_images, ','), ''))) AS h FROM eval_queries)
SELECT h, min(query_id) AS kept, count(DISTINCT query_id) - 1 AS dropped FROM q GROUP BY h""")
def pair_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """SG22: pairs with the same question, answer and images, one kept."""
    text = lambda c: F.coalesce(c, F.lit(""))
    h = F.md5(F.concat_ws("|", text(F.col("question")), text(F.col("ground_truth.diagnosis")), text(F.array_join("query_images", ","))))
    return table(spark, d, "eval_queries").select("query_id", h.alias("h")).groupBy("h").agg(F.min("query_id").alias("kept"), (F.count_distinct("query_id") - 1).alias("dropped"))


@query(r"""SELECT DISTINCT query_id, array_to_string(list_filter([CASE WHEN case_id IS NULL THEN 'case_id missing' END, CASE WHEN question IS NULL THEN 'question missing' WHEN trim(question) = '' THEN 'question empty' END,
CASE WHEN clinical_context IS NULL THEN 'clinical_context missing' WHEN trim(clinical_context) = '' THEN 'clinical_context empty' END, CASE WHEN ground_truth.diagnosis IS NULL THEN 'ground_truth.diagnosis missing' END,
CASE WHEN ground_truth.species IS NULL THEN 'ground_truth.species missing' END, CASE WHEN coalesce(len(query_images), 0) = 0 THEN 'query_images empty' END], lambda x: x IS NOT NULL), '; ') AS issues FROM eval_queries""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """PF20, EV43: what is missing or empty in a row, nested fields and lists included."""

    def issue(c: str, blank: bool = False) -> Column:
        out = F.when(F.col(c).isNull(), f"{c} missing")
        return out.when(F.trim(c) == "", f"{c} empty") if blank else out

    issues = F.array_compact(F.array(issue("case_id"), issue("question", True), issue("clinical_context", True), issue("ground_truth.diagnosis"), issue("ground_truth.species"), F.when(F.coalesce(F.size("query_images"), F.lit(0)) <= 0, "query_images empty")))
    return table(spark, d, "eval_queries").select("query_id", F.array_join(issues, "; ").alias("issues")).distinct()


@query("""WITH p AS (SELECT doc_id, page_index, bool_or(coalesce(contains(lower(text_excerpt), 'biopsy'), false)) AS hit FROM page_hits WHERE doc_id IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL),
n AS (SELECT DISTINCT doc_id, page_index + o AS page_index FROM p, (VALUES (-1), (0), (1)) t(o) WHERE hit)
SELECT doc_id, page_index, hit FROM p JOIN n USING (doc_id, page_index)""")
def pages_around_hits(spark: SparkSession, d: str) -> DataFrame:
    """PF24: pages with a keyword and those before and behind them."""
    p = table(spark, d, "page_hits").where("doc_id is not null and page_index is not null").groupBy("doc_id", "page_index").agg(F.max(F.coalesce(F.contains(F.lower("text_excerpt"), F.lit("biopsy")), F.lit(False))).alias("hit"))
    near = p.where("hit").select("doc_id", F.explode(F.array(*[F.col("page_index") + o for o in (-1, 0, 1)])).alias("page_index")).distinct()
    return p.join(near, ["doc_id", "page_index"]).select("doc_id", "page_index", "hit")


@query("""WITH v AS (SELECT DISTINCT lower(trim(diagnosis)) AS v FROM diagnosis_labels WHERE len(trim(diagnosis)) >= 4), c AS (SELECT entry_id, lower(canonical_name) AS c FROM diagnosis_catalog WHERE list_name = 'diagnosis'),
x AS (SELECT entry_id, c, substr(c, 1, n) AS p FROM c, LATERAL (SELECT unnest(range(4, len(c) + 1)) AS n)),
m AS (SELECT v, min(entry_id) AS entry_id, count(DISTINCT entry_id) AS n, bool_or(c = v) AS same FROM v JOIN x ON v = p GROUP BY v)
SELECT v, entry_id, CASE WHEN same THEN 'exact' ELSE 'unique prefix' END AS tier FROM (SELECT v, CASE WHEN same THEN (SELECT min(entry_id) FROM c WHERE c.c = m.v) ELSE entry_id END AS entry_id, n, same FROM m) WHERE same OR n = 1""")
def prefix_keys(spark: SparkSession, d: str) -> DataFrame:
    """JN14: values that begin exactly one name of the list, after those that equal one."""
    v = table(spark, d, "diagnosis_labels").select(F.lower(F.trim("diagnosis")).alias("v")).where("length(v) >= 4").distinct()
    c = table(spark, d, "diagnosis_catalog").where("list_name = 'diagnosis'").select("entry_id", F.lower("canonical_name").alias("c")).where("length(c) >= 4")
    x = c.select("entry_id", "c", F.explode(F.transform(F.sequence(F.lit(4), F.length("c")), lambda n: F.substring("c", F.lit(1), n))).alias("v"))
    m = v.join(x, "v").groupBy("v").agg(F.min("entry_id").alias("e"), F.count_distinct("entry_id").alias("n"), F.min(F.when(F.col("c") == F.col("v"), F.col("entry_id"))).alias("same"))
    return m.where("same is not null or n = 1").select("v", F.coalesce("same", "e").alias("entry_id"), F.when(F.col("same").isNotNull(), "exact").otherwise("unique prefix").alias("tier"))


_NORMAL = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH e AS (SELECT DISTINCT query_id, case_id, {_NORMAL.format("question")} AS k FROM eval_queries WHERE case_id IS NOT NULL AND question IS NOT NULL),
a AS (SELECT DISTINCT answer_id, split_part(qid, '::', 1) AS case_id, {_NORMAL.format("split_part(query, chr(10), 1)")} AS k FROM answer_records WHERE qid IS NOT NULL AND query IS NOT NULL)
SELECT query_id, count(answer_id) AS answers FROM e LEFT JOIN a USING (case_id, k) GROUP BY query_id""")
def case_question_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JN18: answers of a question by case and question text without case, marks and blanks."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    e = table(spark, d, "eval_queries").where("case_id is not null and question is not null").select("query_id", "case_id", normal("question").alias("k")).distinct()
    a = table(spark, d, "answer_records").where("qid is not null and query is not null").select("answer_id", F.split("qid", "::")[0].alias("case_id"), normal(F.split("query", "\n")[0]).alias("k")).distinct()
    return e.join(a, ["case_id", "k"], "left").groupBy("query_id").agg(F.count("answer_id").alias("answers"))


@query("""WITH a AS (SELECT answer_id, bool_or(answer_format_valid) AS v, max(ingested_at) AS t FROM answer_records GROUP BY 1), f AS (SELECT answer_id, bool_or(answer_format_valid) AS v FROM format_analyses GROUP BY 1),
r AS (SELECT answer_id, bool_or(len(trim(answer)) > 0) AS v FROM answer_records WHERE format_retry_count > 0 GROUP BY 1)
SELECT a.answer_id, coalesce(r.v, f.v, a.v) AS valid, CASE WHEN r.v IS NOT NULL THEN 3 WHEN f.v IS NOT NULL THEN 2 WHEN a.v IS NOT NULL THEN 1 ELSE 0 END AS phase, f.answer_id IS NOT NULL AND a.v IS NOT NULL AS complete FROM a LEFT JOIN f USING (answer_id) LEFT JOIN r USING (answer_id)""")
def phase_override(spark: SparkSession, d: str) -> DataFrame:
    """JN20, EV42: three phases merged by key, the latest that says something wins, and whether the first two are there."""
    a = table(spark, d, "answer_records").groupBy("answer_id").agg(F.max("answer_format_valid").alias("v1"))
    f = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.max("answer_format_valid").alias("v2"), F.lit(True).alias("there"))
    r = table(spark, d, "answer_records").where("format_retry_count > 0").groupBy("answer_id").agg(F.max(F.length(T.trimmed(F.col("answer"))) > 0).alias("v3"))
    j = a.join(f, "answer_id", "left").join(r, "answer_id", "left")
    phase = F.when(F.col("v3").isNotNull(), 3).when(F.col("v2").isNotNull(), 2).when(F.col("v1").isNotNull(), 1).otherwise(0)
    return j.select("answer_id", F.coalesce("v3", "v2", "v1").alias("valid"), phase.alias("phase"), (F.coalesce("there", F.lit(False)) & F.col("v1").isNotNull()).alias("complete"))


@query("""WITH l AS (SELECT case_id, label_id, row_number() OVER (PARTITION BY case_id ORDER BY label_id) AS seq FROM (SELECT DISTINCT case_id, label_id FROM diagnosis_labels WHERE case_id IS NOT NULL)),
q AS (SELECT case_id, query_id, row_number() OVER (PARTITION BY case_id ORDER BY query_id) AS seq FROM (SELECT DISTINCT case_id, query_id FROM eval_queries WHERE case_id IS NOT NULL))
SELECT case_id, seq, label_id, query_id FROM l FULL JOIN q USING (case_id, seq)""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """JN27: two lists of a case side by side by an explicit position, the longer one padded with nulls."""
    part = lambda t, k: table(spark, d, t).where("case_id is not null").select("case_id", k).distinct().withColumn("seq", F.row_number().over(Window.partitionBy("case_id").orderBy(k)))
    return part("diagnosis_labels", "label_id").join(part("eval_queries", "query_id"), ["case_id", "seq"], "full")


@query("""WITH a AS (SELECT DISTINCT answer_id, coalesce(query_type, '') AS bucket, CASE WHEN isnan(top_score) THEN NULL ELSE top_score END AS score, CAST(answer_format_valid AS INT) AS valid, format_retry_count AS retries, prompt_context_count AS contexts,
len(answer) AS chars, len(prompt_context_doc_ids) AS ids, CAST(generation_mode = 'rag_prompt' AS INT) AS rag, CAST(retrieval_support_status = 'supported' AS INT) AS supported, CAST(coalesce(answer_format_error, '') <> '' AS INT) AS failed FROM answer_records)
SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, """ + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("score", "valid", "retries", "contexts", "chars", "ids", "rag", "supported", "failed")) + " FROM a GROUP BY GROUPING SETS ((bucket), ())")
def measures_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AG13, AG9: nine measures by bucket and over all; nulls and NaN do not count."""
    score = F.when(~F.isnan("top_score"), F.col("top_score"))
    flag = lambda c: c.cast("int")
    a = table(spark, d, "answer_records").select(
        "answer_id", F.coalesce("query_type", F.lit("")).alias("bucket"), score.alias("score"), flag(F.col("answer_format_valid")).alias("valid"), F.col("format_retry_count").alias("retries"), F.col("prompt_context_count").alias("contexts"),
        F.length("answer").alias("chars"), F.when(F.col("prompt_context_doc_ids").isNotNull(), F.size("prompt_context_doc_ids")).alias("ids"), flag(F.col("generation_mode") == "rag_prompt").alias("rag"),
        flag(F.col("retrieval_support_status") == "supported").alias("supported"), flag(F.coalesce("answer_format_error", F.lit("")) != "").alias("failed"),
    ).distinct()
    names = ["score", "valid", "retries", "contexts", "chars", "ids", "rag", "supported", "failed"]
    return a.rollup("bucket").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in names]).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


@query(r"""WITH g AS (SELECT case_id || '::' || query_type AS qid, min(lower(ground_truth.diagnosis)) AS gold FROM eval_queries WHERE case_id IS NOT NULL AND query_type IS NOT NULL AND ground_truth.diagnosis IS NOT NULL GROUP BY 1),
a AS (SELECT DISTINCT answer_id, qid, lower(answer) AS answer, coalesce(retrieval_support_status, 'none') AS status, top_score FROM answer_records WHERE qid IS NOT NULL)
SELECT split_part(qid, '::', 1) AS case_id, count(*) AS answers, count(gold) AS with_gold, round(avg(CASE WHEN gold IS NOT NULL THEN CAST(contains(coalesce(answer, ''), gold) AS INT) END), 9) AS contained, count_if(status = 'supported') AS supported, count_if(status = 'empty_contexts') AS skipped,
round(avg(CASE WHEN top_score > 0 THEN top_score END), 9) AS mean_score FROM a LEFT JOIN g USING (qid) GROUP BY 1""")
def case_qa_summary(spark: SparkSession, d: str) -> DataFrame:
    """AG38, AG39, AG47: by case, how many answers hold the gold diagnosis, gold coverage, and counts by outcome; a score of 0 is not judged."""
    e = table(spark, d, "eval_queries").where("case_id is not null and query_type is not null and ground_truth.diagnosis is not null")
    g = e.groupBy(F.concat("case_id", F.lit("::"), "query_type").alias("qid")).agg(F.min(F.lower("ground_truth.diagnosis")).alias("gold"))
    a = table(spark, d, "answer_records").where("qid is not null").select("answer_id", "qid", F.lower("answer").alias("answer"), F.coalesce("retrieval_support_status", F.lit("none")).alias("status"), "top_score").distinct()
    held = F.when(F.col("gold").isNotNull(), F.contains(F.coalesce("answer", F.lit("")), F.col("gold")).cast("int"))
    return a.join(g, "qid", "left").groupBy(F.split("qid", "::")[0].alias("case_id")).agg(
        F.count("*").alias("answers"), F.count("gold").alias("with_gold"), F.round(F.avg(held), 9).alias("contained"), F.count_if(F.col("status") == "supported").alias("supported"), F.count_if(F.col("status") == "empty_contexts").alias("skipped"),
        F.round(F.avg(F.when(F.col("top_score") > 0, F.col("top_score"))), 9).alias("mean_score"),
    )


@query("""WITH a AS (SELECT DISTINCT answer_id, top_score AS s, coalesce(answer_format_valid, false) AS y FROM answer_records WHERE top_score IS NOT NULL), t AS (SELECT i / 20.0 AS t FROM range(0, 21) x(i)),
c AS (SELECT CAST(t AS DOUBLE) AS t, count_if(s >= t AND y) AS tp, count_if(s >= t AND NOT y) AS fp, count_if(s < t AND y) AS fn FROM a, t GROUP BY t)
SELECT t AS threshold, tp, fp, fn, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, row_number() OVER (ORDER BY round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) DESC, t) AS place FROM c""")
def f1_sweep(spark: SparkSession, d: str) -> DataFrame:
    """AG43, EV39: F1 at 21 thresholds in one aggregation, the best first."""
    a = table(spark, d, "answer_records").where("top_score is not null").select("answer_id", F.col("top_score").alias("s"), F.coalesce("answer_format_valid", F.lit(False)).alias("y")).distinct()
    c = a.select("s", "y", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / F.lit(20.0))).alias("threshold"))
    above = F.col("s") >= F.col("threshold")
    c = c.groupBy("threshold").agg(F.count_if(above & F.col("y")).alias("tp"), F.count_if(above & ~F.col("y")).alias("fp"), F.count_if(~above & F.col("y")).alias("fn"))
    c = c.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 9))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "threshold")))  # 21 rows


@query("""WITH m AS (SELECT qid, coalesce(model_name, '') AS model, avg(top_score) AS s, bool_and(coalesce(answer_format_valid, false)) AS ok FROM answer_records WHERE qid IS NOT NULL AND top_score IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC) AS place FROM m)
SELECT qid, count(*) AS models, bool_and(ok) AS all_ok, bool_or(ok) AS any_ok, count_if(place = 1) AS shared_first, max(place) AS last_place, round(max(s) - min(s), 9) AS spread FROM r GROUP BY qid""")
def watch_compare(spark: SparkSession, d: str) -> DataFrame:
    """WN22, EV37: questions across runs: whether all or any are valid, and how far the runs rank apart."""
    m = table(spark, d, "answer_records").where("qid is not null and top_score is not null").groupBy("qid", F.coalesce("model_name", F.lit("")).alias("model")).agg(F.avg("top_score").alias("s"), F.min(F.coalesce("answer_format_valid", F.lit(False))).alias("ok"))
    r = m.withColumn("place", F.rank().over(Window.partitionBy("qid").orderBy(F.desc(F.round("s", 9)))))
    return r.groupBy("qid").agg(F.count("*").alias("models"), F.min("ok").alias("all_ok"), F.max("ok").alias("any_ok"), F.count_if(F.col("place") == 1).alias("shared_first"), F.max("place").alias("last_place"), F.round(F.max("s") - F.min("s"), 9).alias("spread"))


@query("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
m AS (SELECT label, i, avg(x / n) AS m FROM e JOIN n USING (vec_id) GROUP BY ALL), k AS (SELECT label, sqrt(sum(m * m)) AS k FROM m GROUP BY 1)
SELECT label, i, round(m / k, 6) AS mean FROM m JOIN k USING (label)""")
def label_means(spark: SparkSession, d: str) -> DataFrame:
    """MV2, SG7: unit vectors pooled to the mean of each label, all elements, and brought to unit length again."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "y")).select("vec_id", "label", (F.col("p") + 1).cast("bigint").alias("i"), F.col("y").cast("double").alias("x"))
    n = e.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    m = e.join(n, "vec_id").groupBy("label", "i").agg(F.avg(F.col("x") / F.col("n")).alias("m"))
    k = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("k"))
    return m.join(k, "label").select("label", "i", F.round(F.col("m") / F.col("k"), 6).alias("mean"))


@query(_DENSE.replace("rank <= 10", "rank <= 16") + """, l AS (SELECT r.qid, v.label, max(r.score) AS best, sum(exp(20 * r.score)) AS e FROM r JOIN v ON v.vec_id = r.doc_id GROUP BY ALL),
p AS (SELECT qid, label, best, e / sum(e) OVER (PARTITION BY qid) AS share FROM l),
o AS (SELECT *, row_number() OVER w AS k, round(share, 6) - coalesce(lead(round(share, 6)) OVER w, 0) AS margin FROM p WINDOW w AS (PARTITION BY qid ORDER BY round(share, 6) DESC, label))
SELECT qid, label, round(best, 6) AS best, round(share, 6) AS share, round(margin, 6) AS margin, margin < 0.1 AS unsure FROM o WHERE k = 1""")
def neighbour_vote(spark: SparkSession, d: str) -> DataFrame:
    """MV11, MV12, MV14, MV4: labels of the sixteen nearest vote by sharpened similarity; the best neighbour of a label stands for it, and a small margin leaves the vote unsure."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    l = dense(spark, d, 16).join(v, "doc_id").groupBy("qid", "label").agg(F.max("score").alias("best"), F.sum(F.exp(20 * F.col("score"))).alias("e"))  # noqa: E741
    p = l.withColumn("share", F.round(F.col("e") / F.sum("e").over(Window.partitionBy("qid")), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("share"), "label")
    o = p.withColumn("k", F.row_number().over(w)).withColumn("margin", F.col("share") - F.coalesce(F.lead("share").over(w), F.lit(0.0))).where("k = 1")
    return o.select("qid", "label", F.round("best", 6).alias("best"), "share", F.round("margin", 6).alias("margin"), (F.col("margin") < 0.1).alias("unsure"))


@query("""WITH h AS (SELECT question_id AS qid, doc_id, page_index, max(CASE WHEN via = 'dense' THEN score ELSE 0 END) AS a, max(CASE WHEN via = 'sparse' THEN score ELSE 0 END) AS b, bool_or(coalesce(page_kind, '') = 'mixed') AS rel
FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL AND score IS NOT NULL GROUP BY ALL), g AS (SELECT i / 4.0 AS alpha FROM range(0, 5) t(i)),
s AS (SELECT alpha, qid, rel, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * a + (1 - alpha) * b, 9) DESC, doc_id, page_index) AS place FROM h, g),
q AS (SELECT alpha, qid, bool_or(rel AND place <= 1) AS h1, bool_or(rel AND place <= 3) AS h3 FROM s GROUP BY ALL)
SELECT CAST(alpha AS DOUBLE) AS alpha, count(*) AS queries, round(avg(CAST(h1 AS INT)), 9) AS hit_1, round(avg(CAST(h3 AS INT)), 9) AS hit_3, row_number() OVER (ORDER BY round(avg(CAST(h1 AS INT)), 9) DESC, round(avg(CAST(h3 AS INT)), 9) DESC, alpha) AS place FROM q GROUP BY alpha""")
def blend_grid(spark: SparkSession, d: str) -> DataFrame:
    """EV40, EV41, MV13: hit at 1 and 3 of two lanes blended with each of five weights, the best first; every list is ranked anew for each weight."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and score is not null")
    lane = lambda v: F.max(F.when(F.col("via") == v, F.col("score")).otherwise(0.0))
    h = h.groupBy(F.col("question_id").alias("qid"), "doc_id", "page_index").agg(lane("dense").alias("a"), lane("sparse").alias("b"), F.max(F.coalesce(F.col("page_kind") == "mixed", F.lit(False))).alias("rel"))
    s = h.withColumn("alpha", F.explode(F.array(*[F.lit(i / 4) for i in range(5)])))
    score = F.round(F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b"), 9)
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("alpha", "qid").orderBy(score.desc(), "doc_id", "page_index")))
    hit = lambda k: F.max((F.col("rel") & (F.col("place") <= k)).cast("int"))
    q = s.groupBy("alpha", "qid").agg(hit(1).alias("h1"), hit(3).alias("h3"))
    g = q.groupBy("alpha").agg(F.count("*").alias("queries"), F.round(F.avg("h1"), 9).alias("hit_1"), F.round(F.avg("h3"), 9).alias("hit_3"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hit_1"), F.desc("hit_3"), "alpha")))  # five rows


@query("""WITH h AS (SELECT question_id AS qid, doc_id, page_index, bool_or(coalesce(micrograph_like, false)) AS micro, bool_or(text_excerpt IS NOT NULL) AS text, bool_or(via = 'seed_image') AS seed, min(rank) AS rank, count(*) AS n FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND page_index IS NOT NULL GROUP BY ALL)
SELECT qid, count(*) AS pages, round(avg(CAST(text AS INT)), 9) AS text_coverage, round(1 - count(*) / sum(n), 9) AS duplicate_ratio, count_if(micro) AS figures, array_to_string(list_filter([CASE WHEN avg(CAST(text AS INT)) < 0.5 THEN 'little text' END,
CASE WHEN count(*) < 2 THEN 'one page' END, CASE WHEN count_if(micro) = 0 THEN 'no figure' END, CASE WHEN 1 - count(*) / sum(n) > 0.5 THEN 'repeats' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM h GROUP BY qid""")
def list_quality(spark: SparkSession, d: str) -> DataFrame:
    """EV13, EV14: text coverage, repeats, unique pages and figures of a list, and warnings where a bound is missed."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null").groupBy(F.col("question_id").alias("qid"), "doc_id", "page_index")
    h = h.agg(F.max(F.coalesce("micrograph_like", F.lit(False))).alias("micro"), F.max(F.col("text_excerpt").isNotNull()).alias("text"), F.count("*").alias("n"))
    g = h.groupBy("qid").agg(F.count("*").alias("pages"), F.avg(F.col("text").cast("int")).alias("c"), (1 - F.count("*") / F.sum("n")).alias("r"), F.count_if("micro").alias("figures"))
    warn = F.array_compact(F.array(F.when(F.col("c") < 0.5, "little text"), F.when(F.col("pages") < 2, "one page"), F.when(F.col("figures") == 0, "no figure"), F.when(F.col("r") > 0.5, "repeats")))
    return g.select("qid", "pages", F.round("c", 9).alias("text_coverage"), F.round("r", 9).alias("duplicate_ratio"), "figures", F.array_join(warn, "; ").alias("warnings"))


_PAGE_LIST = "string_agg(DISTINCT lpad(page_index::VARCHAR, 4, '0'), ',' ORDER BY lpad(page_index::VARCHAR, 4, '0')) FILTER ({})"


@query(f"""SELECT question_id AS qid, coalesce({_PAGE_LIST.format("page_kind = 'mixed'")}, {_PAGE_LIST.format("coalesce(len(keywords), 0) > 0")}, {_PAGE_LIST.format("via = 'seed_image'")}, {_PAGE_LIST.format("rank = 1")}, '0000,0001,0002') AS gold,
CASE WHEN count_if(page_kind = 'mixed') > 0 THEN 'explicit' WHEN count_if(coalesce(len(keywords), 0) > 0) > 0 THEN 'keywords' WHEN count_if(via = 'seed_image') > 0 THEN 'seeds' WHEN count_if(rank = 1) > 0 THEN 'used' ELSE 'default' END AS source
FROM page_hits WHERE question_id IS NOT NULL AND page_index IS NOT NULL GROUP BY 1""")
def gold_sources(spark: SparkSession, d: str) -> DataFrame:
    """EV15: gold pages from the first of five sources that knows any, and which it was."""
    h = table(spark, d, "page_hits").where("question_id is not null and page_index is not null")
    tests = {"explicit": F.col("page_kind") == "mixed", "keywords": F.coalesce(F.size("keywords"), F.lit(0)) > 0, "seeds": F.col("via") == "seed_image", "used": F.col("rank") == 1}
    page = F.lpad(F.col("page_index").cast("string"), 4, "0")
    g = h.groupBy(F.col("question_id").alias("qid")).agg(*[F.array_join(F.array_sort(F.collect_set(F.when(t, page))), ",").alias(n) for n, t in tests.items()])
    known = lambda n: F.col(n) != ""
    source = F.lit("default")
    for n in reversed(list(tests)):
        source = F.when(known(n), n).otherwise(source)
    return g.select("qid", F.coalesce(*[F.when(known(n), F.col(n)) for n in tests], F.lit("0000,0001,0002")).alias("gold"), source.alias("source"))


@query(None)
def diverse_texts(spark: SparkSession, d: str) -> DataFrame:
    """TK12: pages of a question one after another, unless their words are more than four fifths those of a page taken before; then filled up in order."""
    h = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and page_index is not null and score is not null")
    p = h.groupBy(F.col("question_id").alias("qid"), F.concat("doc_id", F.lit(":"), F.col("page_index").cast("string")).alias("doc_id")).agg(F.max("score").alias("score"), F.max("text_excerpt").alias("text"))
    return K.diverse_texts(p, 4, 0.8)
