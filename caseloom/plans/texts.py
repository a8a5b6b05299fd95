"""Text functions, chunks, samples, entities and incremental batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions import vectors as V
from caseloom.operators import entities as N
from caseloom.operators import incremental as I
from caseloom.operators import retrieval as S
from caseloom.operators import sampling as P
from caseloom.sources.files import nested_qrels
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


_TOKENS = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda w: w <> '')"
_WORDS = r"list_filter(regexp_split_to_array(trim({}), '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_TOKENS}) AS tokens, len(list_distinct({_TOKENS})) AS distinct_tokens FROM documents")
def bm25_tokens(spark: SparkSession, d: str) -> DataFrame:
    """SC3, SC4: words of a text."""
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("distinct_tokens"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM w WHERE length(term) > 4 AND term NOT IN ('which', 'there', 'their', 'after') GROUP BY ALL)
SELECT doc_id, term, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 5""")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    """SC5, SC6, SC7, TK9: the five most frequent terms of a text, counted before they are ranked."""
    terms = T.ascii_terms(F.col("text"), ("which", "there", "their", "after"), 4)
    n = table(spark, d, "documents").select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))).where("_r <= 5").drop("_r")


_LEAKS = ["leishmaniasis", "leishmania", "miltefosine"]


@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)\b(?:leishmaniasis|leishmania|miltefosine)\b', '[REDACTED]', 'g')) AS redacted FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    """SC8: terms masked in all texts; word edges go by ASCII letters in both engines."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.redacted(F.col("text"), _LEAKS)).alias("redacted"))


@query(r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: trim(s)), lambda s: s <> '')) AS sentences FROM documents")
def sentence_count(spark: SparkSession, d: str) -> DataFrame:
    """SC9: sentences of a text."""
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query(r"""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(lower(regexp_replace(text, '\s+', ' ', 'g')))""")
def text_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """SC27, SC28, PF10: copies of whole texts but for case and blanks."""
    return table(spark, d, "documents").groupBy(F.sha2(F.lower(T.collapsed(F.col("text"))), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(r"SELECT doc_id, array_to_string(regexp_split_to_array(trim(lower(text)), '\s+')[1:8], ' ') AS title_key FROM documents")
def title_key(spark: SparkSession, d: str) -> DataFrame:
    """SC29: the first eight words."""
    return table(spark, d, "documents").select("doc_id", T.title_key(F.col("text")).alias("title_key"))


_NOISE = [r"^\s*-? ?[0-9]+ ?-?\s*$", "^Page "]


@query(r"""SELECT hit_id, array_to_string(list_filter(regexp_split_to_array(text_excerpt, '\r\n|\n|\r'), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^\s*-? ?[0-9]+ ?-?\s*$|^Page ')), chr(10)) AS kept FROM page_hits WHERE text_excerpt IS NOT NULL""")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """PF21, PF22, SC32: lines without noise in all excerpts, whatever their line ends."""
    return table(spark, d, "page_hits").where("text_excerpt is not null").select("hit_id", T.clean_lines(F.col("text_excerpt"), _NOISE).alias("kept"))


@query("""SELECT doc_id, CASE WHEN lower(text) LIKE '%case%' OR lower(text) LIKE '%patient%' THEN 'case' WHEN lower(text) LIKE '%treatment%' THEN 'therapy' WHEN lower(text) LIKE '%sensitivity%' THEN 'test' ELSE 'other' END AS kind,
CAST(lower(text) LIKE '%biopsy%' AS DOUBLE) + CAST(lower(text) LIKE '%amastigote%' AS DOUBLE) - 0.75 * CAST(lower(text) LIKE '%no organisms%' AS DOUBLE) AS support FROM documents""")
def classify_chain(spark: SparkSession, d: str) -> DataFrame:
    """SC19, SC21, PF5, PF6: ordered rules and a signal score."""
    low = F.lower("text")
    kind = T.first_class(low, [("case", "case|patient"), ("therapy", "treatment"), ("test", "sensitivity")], "other")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"), T.signal_score(low, ["biopsy", "amastigote"], ["no organisms"]).alias("support"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) > 1000 THEN left(text, 500) || chr(10) || '[...]' || chr(10) || right(text, 500) ELSE text END) AS cut FROM documents""")
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    """SC34, SC35: head and tail of long texts."""
    return table(spark, d, "documents").select("doc_id", F.md5(T.head_tail(F.col("text"), 500, 500)).alias("cut"))


@query(r"SELECT DISTINCT query_id, regexp_extract(clinical_context, '([0-9]{1,3})-year-old (male|female)', 1) AS age, regexp_extract(clinical_context, '([0-9]{1,3})-year-old (male|female)', 2) AS gender FROM eval_queries WHERE clinical_context IS NOT NULL")
def demographics(spark: SparkSession, d: str) -> DataFrame:
    """SC11, SC23, SC56: fields drawn out by pattern."""
    get = lambda g: F.regexp_extract("clinical_context", "([0-9]{1,3})-year-old (male|female)", g)
    return table(spark, d, "eval_queries").where("clinical_context is not null").select("query_id", get(1).alias("age"), get(2).alias("gender")).distinct()


@query("""SELECT DISTINCT case_id, split_part(regexp_replace(case_id, '-', '_'), '_', 1) AS article, substr(sha256(case_id), 1, 24) AS stable_key FROM eval_queries WHERE case_id IS NOT NULL""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """MV16, SC31: prefixes and stable keys of ids."""
    c = F.col("case_id")
    return table(spark, d, "eval_queries").where(c.isNotNull()).select(c, F.split(F.regexp_replace(c, "-", "_"), "_")[0].alias("article"), F.substring(F.sha2(c, 256), 1, 24).alias("stable_key")).distinct()


_CHUNK = f"""WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 307) / 269.0)) AS BIGINT) + 1)) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk, len(w[chunk * 269 + 1 : chunk * 269 + 307]) AS words, md5(array_to_string(w[chunk * 269 + 1 : chunk * 269 + 307], ' ')) AS hash FROM c"""


@query(_CHUNK)
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """RT1, RT4, UD6: overlapping word windows."""
    return S.fixed_chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("words").cast("bigint").alias("words"), F.md5("chunk_text").alias("hash"))


@query(None)
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    """RT3, SC36: sentences packed to a token budget."""
    return S.sentence_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """MV1 to : lengths and unit vectors."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(F.element_at(V.unit(e), 1), 6).alias("first"))


@query("""WITH s AS (SELECT vec_id, label, exp(8.0 * embedding[1]) AS e FROM embeddings) SELECT vec_id, round(e / sum(e) OVER (PARTITION BY label), 6) AS weight FROM s""")
def proto_vote(spark: SparkSession, d: str) -> DataFrame:
    """Softmax weights of one coordinate within a group."""
    e = F.exp(8.0 * F.element_at("embedding", 1).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(e / F.sum(e).over(Window.partitionBy("label")), 6).alias("weight"))


@query(None)
def proto_vote_whole(spark: SparkSession, d: str) -> DataFrame:
    """MV12: exp(80 * cosine) of an item to the mean of each label, as shares over all labels."""
    v = table(spark, d, "embeddings").where("label is not null").select("vec_id", "label", V.unit(F.col("embedding")).alias("u"))
    mean = v.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    p = mean.groupBy("label").agg(V.unit(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"])).alias("p"))
    s = v.select("vec_id", "u").crossJoin(F.broadcast(p)).select("vec_id", "label", F.aggregate(F.zip_with("u", "p", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x).alias("s"))  # one row a label
    w = Window.partitionBy("vec_id")
    e = s.withColumn("e", F.exp(80.0 * (F.col("s") - F.max("s").over(w))))
    return e.select("vec_id", "label", F.round(F.col("e") / F.sum("e").over(w), 6).alias("weight"))


_U = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0)"


@query(f"""WITH x AS (SELECT DISTINCT label_id, coalesce(confidence, '') AS c FROM diagnosis_labels), n AS (SELECT c, count(DISTINCT label_id) AS n FROM x GROUP BY 1)
SELECT label_id, c AS confidence, CASE WHEN {_U.format("concat_ws('|', '42', label_id)")} < 0.2 AND n > 1 THEN 'test' ELSE 'train' END AS split FROM x JOIN n USING (c)""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """SG2: split by hash within strata."""
    x = table(spark, d, "diagnosis_labels").select("label_id", F.coalesce("confidence", F.lit("")).alias("confidence")).distinct()
    return P.stratified_split(x, "label_id", "confidence", 0.2).select("label_id", "confidence", "split")


@query("""WITH x AS (SELECT DISTINCT label_id, coalesce(confirmation_method, '') AS m FROM diagnosis_labels)
SELECT label_id, m AS method FROM x QUALIFY row_number() OVER (PARTITION BY m ORDER BY md5(concat_ws('|', '42', label_id)), label_id) <= 10""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """SG19, TK10: at most ten of each kind, in hash order."""
    x = table(spark, d, "diagnosis_labels").select("label_id", F.coalesce("confirmation_method", F.lit("")).alias("method")).distinct()
    return P.quota_sample(x, "label_id", "method", 10)


@query("""WITH x AS (SELECT DISTINCT label_id, coalesce(confirmation_method, '') AS m FROM diagnosis_labels), n AS (SELECT m, greatest(1, round(count(*) * 100.0 / sum(count(*)) OVER ())) AS t FROM x GROUP BY 1)
SELECT label_id, m AS method FROM x JOIN n USING (m) QUALIFY row_number() OVER (PARTITION BY m ORDER BY md5(concat_ws('|', '42', label_id)), label_id) <= t""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample by shares of the strata, in part SG5: no top-up."""
    x = table(spark, d, "diagnosis_labels").select("label_id", F.coalesce("confirmation_method", F.lit("")).alias("method")).distinct()
    return P.proportional_sample(x, "label_id", "method", 100).select("label_id", "method")


@query("""WITH q AS (SELECT DISTINCT query_id, case_id, split FROM eval_queries) SELECT query_id, CASE WHEN case_id IN (SELECT case_id FROM q WHERE split = 'train' AND case_id IS NOT NULL) THEN 'train' ELSE split END AS split FROM q""")
def leak_repair(spark: SparkSession, d: str) -> DataFrame:
    """SG1, SG8, ST9: cases that are also in train move there whole."""
    q = table(spark, d, "eval_queries").select("query_id", "case_id", "split").distinct()
    return P.leak_repair(q, "case_id", "split").select("query_id", "split")


@query("""WITH s AS (SELECT case_id, string_agg(DISTINCT diagnosis, '|' ORDER BY diagnosis) AS signature FROM diagnosis_labels WHERE diagnosis IS NOT NULL GROUP BY 1) SELECT signature, count(*) AS cases FROM s GROUP BY 1""")
def signature_split(spark: SparkSession, d: str) -> DataFrame:
    """AG46: cases by the set of their diagnoses."""
    return P.signature(table(spark, d, "diagnosis_labels"), "case_id", "diagnosis").groupBy("signature").agg(F.count("*").alias("cases"))


@query("SELECT diagnosis, count(DISTINCT case_id) AS keys FROM diagnosis_labels WHERE diagnosis IS NOT NULL GROUP BY 1 HAVING count(DISTINCT case_id) <= 3")
def rare_entities(spark: SparkSession, d: str) -> DataFrame:
    """SG6: diagnoses of at most three cases."""
    return N.rare(table(spark, d, "diagnosis_labels"), "diagnosis", "case_id")


_NER = r"""WITH t AS (SELECT DISTINCT entry_id AS entity, array_to_string(list_filter(regexp_split_to_array(lower(s), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') AS term FROM
(SELECT entry_id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS s FROM diagnosis_catalog WHERE list_name = 'diagnosis')),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), r AS (SELECT doc_id, array_to_string(w[i : i + n - 1], ' ') AS term FROM i, range(1, 7) x(n) WHERE i + n - 1 <= len(w)),
m AS (SELECT doc_id, entity, term, count(*) AS mentions FROM r JOIN t USING (term) GROUP BY ALL) """


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "diagnosis_catalog").where("list_name = 'diagnosis'")
    terms = c.select("entry_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    return N.dictionary_mentions(table(spark, d, "documents"), "doc_id", "text", terms, "term", "entry_id")


@query(_NER + "SELECT * FROM m")
def dict_ner(spark: SparkSession, d: str) -> DataFrame:
    """SG9, SC42, UD7: catalogue names in whole texts."""
    return _mentions(spark, d)


@query(_NER + "SELECT entity, count(DISTINCT doc_id) AS documents, CAST(sum(mentions) AS BIGINT) AS mentions, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM m GROUP BY 1")
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SG10, SG11, SC54: entity nodes with their terms."""
    return N.nodes(_mentions(spark, d)).withColumn("terms", F.array_join("terms", "|"))


@query(_NER + "SELECT DISTINCT doc_id, entity, 'doc/' || doc_id || ' names entity/' || entity AS triple FROM m")
def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    """SG12: document-entity edges."""
    return N.edges(_mentions(spark, d)).withColumn("triple", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(" names entity/"), F.col("entity").cast("string")))


@query("""WITH c AS (SELECT case_id, max(coalesce(len(query_images), 0)) AS n FROM eval_queries WHERE case_id IS NOT NULL GROUP BY 1)
SELECT case_id || '::' || t AS qid FROM c, LATERAL (SELECT unnest(CASE WHEN n > 0 THEN ['Q1', 'Q2', 'Q1_Q3'] ELSE ['Q1', 'Q2'] END) AS t)""")
def query_set(spark: SparkSession, d: str) -> DataFrame:
    """SG15, JN11, SC49, SC50: the queries of a case, an image query only where there are images."""
    c = table(spark, d, "eval_queries").where("case_id is not null").groupBy("case_id").agg(F.max(F.coalesce(F.size("query_images"), F.lit(0))).alias("n"))
    kinds = F.array_compact(F.array(F.lit("Q1"), F.lit("Q2"), F.when(F.col("n") > 0, F.lit("Q1_Q3"))))
    return c.select(F.explode(kinds).alias("t"), "case_id").select(F.concat("case_id", F.lit("::"), "t").alias("qid"))


@query("SELECT DISTINCT answer_id FROM answer_records WHERE answer_id NOT IN (SELECT answer_id FROM format_analyses WHERE answer_id IS NOT NULL)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """SM1, SM6: answers that have no analysis yet."""
    return I.pending(table(spark, d, "answer_records").select("answer_id").distinct(), table(spark, d, "format_analyses"), "answer_id")


@query("SELECT DISTINCT answer_id, model_name FROM answer_records WHERE answer_id IN (SELECT answer_id FROM format_analyses WHERE nullif(trim(answer_format_error), '') IS NOT NULL)")
def retry_set(spark: SparkSession, d: str) -> DataFrame:
    """SM2: answers whose analysis failed."""
    failed = table(spark, d, "format_analyses").where("nullif(trim(answer_format_error), '') is not null")
    return I.retry_set(table(spark, d, "answer_records").select("answer_id", "model_name").distinct(), failed, "answer_id")


@query("SELECT answer_id, max(ingested_at) AS ingested_at, bool_or(coalesce(answer_format_valid, false)) AS any_valid FROM answer_records GROUP BY 1")
def compact_latest(spark: SparkSession, d: str) -> DataFrame:
    """SM3, A17: the latest delivery of an answer."""
    return table(spark, d, "answer_records").groupBy("answer_id").agg(F.max("ingested_at").alias("ingested_at"), F.max(F.coalesce("answer_format_valid", F.lit(False))).alias("any_valid"))


@query("""WITH c AS (SELECT answer_id, max(diagnosis_family) AS v FROM format_analyses GROUP BY 1)
SELECT DISTINCT a.answer_id, CASE WHEN coalesce(a.answer_format_valid, false) THEN a.query_type ELSE coalesce(c.v, a.query_type) END AS query_type FROM answer_records a LEFT JOIN c USING (answer_id)""")
def repair_from_cache(spark: SparkSession, d: str) -> DataFrame:
    """SM4, SM11, IO21: values of a cache where a row is not ok."""
    cache = table(spark, d, "format_analyses").groupBy("answer_id").agg(F.max("diagnosis_family").alias("query_type"))
    return I.repaired(table(spark, d, "answer_records").select("answer_id", "answer_format_valid", "query_type"), cache, "answer_id", "answer_format_valid", "query_type").select("answer_id", "query_type").distinct()


@query("SELECT DISTINCT hit_id FROM page_hits WHERE question_id IN (SELECT qid FROM answer_records)")
def prune_cache(spark: SparkSession, d: str) -> DataFrame:
    """SM5, JN6: hits of questions that still have answers."""
    live = table(spark, d, "answer_records").select(F.col("qid").alias("question_id"))
    return I.pruned(table(spark, d, "page_hits").select("hit_id", "question_id"), live, "question_id").select("hit_id").distinct()


@query("""WITH g AS (SELECT question_id AS qid, doc_id, max(rank) AS grade FROM page_hits WHERE question_id IS NOT NULL AND doc_id IS NOT NULL AND rank IS NOT NULL GROUP BY ALL)
SELECT qid, '{' || string_agg('"' || doc_id || '":' || grade, ',' ORDER BY doc_id) || '}' AS judged FROM g GROUP BY 1""")
def qrels_json(spark: SparkSession, d: str) -> DataFrame:
    """IO27, IO28, A10: judgements of a question as one JSON object."""
    g = table(spark, d, "page_hits").where("question_id is not null and doc_id is not null and rank is not null").groupBy(F.col("question_id").alias("qid"), "doc_id").agg(F.max("rank").alias("grade"))
    return nested_qrels(g)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    """PF1, AG45, SC59: a field of JSON text."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT hit_id, rank, k AS keyword FROM (SELECT DISTINCT hit_id, rank, keywords FROM page_hits), LATERAL (SELECT unnest(keywords) AS k)")
def unnest_list(spark: SparkSession, d: str) -> DataFrame:
    """PF2, PF14: list elements as rows."""
    return table(spark, d, "page_hits").select("hit_id", "rank", "keywords").distinct().select("hit_id", "rank", F.explode("keywords").alias("keyword"))
