"""Inputs on which a query once differed from its SQL or from its whole job."""

import os
from collections import Counter

import duckdb
import numpy as np

from caseloom.operators import retrieval
from caseloom.plans import lists, passages, reports

ODD = ["\u00a0", "\u2003\u3000", " \u00a0Ulcer.\u2009Culture \u202f! \u00a0", "\u00a0Final Answer\t:\r\n\u00a0Leish.", "final answer\x0b: Leish", "final an\u017fwer: Leish", "\t", "", " ", None]


def same_as_sql(spark, folder, module, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}/*.parquet')")
    df = module.QUERIES[name](spark, str(folder))
    rows = con.execute(module.SQL[name])
    order = [[c[0] for c in rows.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in rows.fetchall())
    return df


def test_answer_cleaned_without_space_separators(spark, tmp_path):
    spark.createDataFrame([(i, "Q" if i % 2 else None, t) for i, t in enumerate(ODD)], "answer_id bigint, query string, answer string").write.parquet(f"{tmp_path}/answer_records.parquet")
    out = {r["answer_id"]: r["chars"] for r in same_as_sql(spark, tmp_path, passages, "answer_cleaned").collect()}
    assert out[0] == out[1] == 0


def test_phase_override_takes_space_separators_as_blank(spark, tmp_path):
    spark.createDataFrame([(i, True, 0, t, 1) for i, t in enumerate(ODD)], "answer_id bigint, answer_format_valid boolean, ingested_at bigint, answer string, format_retry_count int").write.parquet(f"{tmp_path}/answer_records.parquet")
    spark.createDataFrame([(i, True) for i in range(0, len(ODD), 2)], "answer_id bigint, answer_format_valid boolean").write.parquet(f"{tmp_path}/format_analyses.parquet")
    out = {r["answer_id"]: r["valid"] for r in same_as_sql(spark, tmp_path, passages, "phase_override").collect()}
    assert not out[0] and not out[1] and out[2]


def test_searches_add_up_repeated_documents(spark, tmp_path):
    texts = [(1, "Skin ulcer, skin biopsy"), (1, "Skin biopsy: ulcer ulcer"), (2, "visceral spleen"), (2, "visceral spleen"), (3, "ulcer of the spleen, old"), (None, "spleen"), (None, "biopsy"), (4, None), (5, ""), (6, " Ulcer_x spleen"), (7, "quite another text")]
    asked = [(20 * i, ["Skin ulcer", "ulcer skin", "visceral", "Skin ulcer", None, "nothing known"][i % 6]) for i in range(30)] + [(20, "spleen"), (21, "ulcer")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (g,)) for i, g in asked], "query_id bigint, ground_truth struct<diagnosis: string>").write.parquet(f"{tmp_path}/eval_queries.parquet")
    for module, name in ((lists, "bm25_search"), (lists, "tfidf_search"), (lists, "hybrid_rrf"), (reports, "kb_overlap")):
        assert same_as_sql(spark, tmp_path, module, name).count() > 0, name


def test_same_terms_are_searched_once(spark):
    terms = [(q, t, 1) for q in range(0, 2000, 20) for t in (("skin", "ulcer") if q % 40 else ("spleen",))]
    seen = []

    def search(asked):
        seen.extend(asked.collect())
        return asked.select("qid", "term")

    out = retrieval.once_each(spark.createDataFrame(terms, "qid bigint, term string, qtf bigint"), search)
    assert sorted(map(tuple, out.collect())) == sorted((q, t) for q, t, _ in terms)
    assert {(r["qid"], r["term"]) for r in seen} == {(0, "spleen"), (20, "skin"), (20, "ulcer")} and len(seen) == 3


def test_frequent_terms_of_a_block_as_one_product():
    random = np.random.default_rng(3)
    docs = [random.zipf(1.5, random.integers(1, 60)) % 97 for _ in range(150)]
    asked = [np.unique(random.zipf(1.4, 20) % 120) for _ in range(40)]
    w = [random.random(len(q)) for q in asked]
    weigh = lambda tf, length, held, norm: tf / (tf + length / 20) + norm / held
    index = retrieval._lexical_index(np.arange(150), np.array([len(d) for d in docs]), np.linspace(0, 1, 150), np.concatenate(docs), weigh)
    want = np.array([[sum(v * weigh((d == t).sum(), len(d), len(set(d)), i / 149) for t, v in zip(q, x) if t in d) for i, d in enumerate(docs)] for q, x in zip(asked, w)])
    for dense in (0.0, 0.02, 0.2, 2.0):
        row, column, score = retrieval._lexical_block(150, index, (np.array([len(q) for q in asked]), np.concatenate(asked), np.concatenate(w)), 7, dense)
        assert np.allclose(score, want[row, column], atol=1e-6)
        for q in range(40):
            assert set(column[row == q]) == {i for i in range(150) if want[q, i] > 1e-6 and np.round(want[q, i], 6) >= np.round(np.sort(want[q])[-7], 6)}


def test_alpha_fusion_asks_with_every_query(spark, tmp_path):
    texts = [(1, "Skin ulcer on the arm"), (2, "Visceral fever and a large spleen"), (3, "Fever, ulcer of the arm"), (4, "quite another text")]
    asked = [(1, "ulcer of the arm", "x"), (19, " ", "Fever and spleen"), (20, "another text", None), (21, "fever", None), (42, None, None), (43, "unknown", None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "query_id bigint, clinical_context string, formatted_query string").write.parquet(f"{tmp_path}/eval_queries.parquet")
    out = {r["qid"]: r["doc_id"] for r in reports.QUERIES["alpha_fusion"](spark, str(tmp_path)).where("rank = 1").collect()}
    assert out.keys() == {1, 19, 20, 21} and out[1] == 3 and out[19] == 2 and out[20] == 4


def labels_of_every_query(spark, tmp_path):
    texts = [(1, "Skin ulcer on the arm"), (2, "Visceral fever and a large spleen"), (3, "Fever, ulcer of the arm"), (4, "quite another text"), (5, "arm")]
    asked = [(1, "skin ulcer"), (19, "visceral fever"), (20, "skin ulcer"), (21, "spleen"), (22, None), (39, "nothing known")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, (g,)) for i, g in asked], "query_id bigint, ground_truth struct<diagnosis: string>").write.parquet(f"{tmp_path}/eval_queries.parquet")
    return {1, 19, 20, 21}


def test_bm25_search_asks_with_every_query(spark, tmp_path):
    want = labels_of_every_query(spark, tmp_path)
    assert {r["qid"] for r in same_as_sql(spark, tmp_path, lists, "bm25_search").collect()} == want


def test_hybrid_rrf_asks_with_every_query(spark, tmp_path):
    want = labels_of_every_query(spark, tmp_path)
    assert {r["qid"] for r in same_as_sql(spark, tmp_path, lists, "hybrid_rrf").collect()} == want


def test_kb_overlap_asks_with_every_query(spark, tmp_path):
    want = labels_of_every_query(spark, tmp_path)
    assert {r["qid"] for r in same_as_sql(spark, tmp_path, reports, "kb_overlap").collect()} == want
