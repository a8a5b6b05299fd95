"""Queries over whole tables that no SQL limits, against brute force."""

import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest

from caseloom.functions import text as T
from caseloom.plans import lists, relations, reports, texts
from caseloom.sources.tables import table
from pyspark.sql import functions as F

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LEAK = re.compile(r"(?<![A-Za-z0-9_])(?:leishmaniasis|leishmania|miltefosine)(?![A-Za-z0-9_])", re.I | re.A)


def test_redacted_beside_other_characters(spark):
    rows = ["LEISHMANIASISâ€“cutaneous", "éMiltefosineé", "leishmania–miltefosine", "leishmaniasis_1 leishmanial", "β-leishmania leishmania,leishmania", ""]
    out = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(T.redacted(F.col("t"), ["leishmaniasis", "leishmania", "miltefosine"])).collect()]
    assert out == [LEAK.sub("[REDACTED]", t) for t in rows]
    assert out[:3] == ["[REDACTED]â€“cutaneous", "é[REDACTED]é", "[REDACTED]–[REDACTED]"]


@needs_tables
def test_redact_covers_every_document(spark):
    texts_of = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    out = {r["doc_id"]: r["redacted"] for r in texts.QUERIES["redact"](spark, DATA).collect()}
    assert out == {i: t if t is None else hashlib.md5(LEAK.sub("[REDACTED]", t).encode()).hexdigest() for i, t in texts_of.items()}
    assert sum(t is not None and not t.isascii() for t in texts_of.values()) > 0


def test_lines_end_in_any_way(spark):
    t = "One\r\n- 3 -\r\n\r\nTwo\rPage 4\rThree\n\n12\r\nFour"
    out = spark.createDataFrame([(t,)], "t string").select(T.clean_lines(F.col("t"), [r"^\s*-? ?[0-9]+ ?-?\s*$", "^Page "])).first()[0]
    assert out == "One\nTwo\nThree\nFour"


@needs_tables
def test_clean_lines_covers_every_excerpt(spark):
    h = table(spark, DATA, "page_hits").where("text_excerpt is not null")
    out = texts.QUERIES["clean_lines"](spark, DATA)
    assert out.count() == h.count() and h.where(F.col("text_excerpt").contains("\r")).count() > 0 and out.where(F.col("kept").contains("\r")).count() == 0


def words(text):
    return re.sub(r"[^\w\s]", " ", text.lower()).split()


def best(scores, k):
    return {q: sorted(((d, s) for d, s in x.items() if s > 0), key=lambda r: (-r[1], r[0]))[:k] for q, x in scores.items()}


@needs_tables
def test_searches_ask_with_the_whole_text(spark):
    docs = {r["doc_id"]: Counter(words(r["text"])) for r in table(spark, DATA, "documents").where("text is not null").collect()}
    docs = {i: c for i, c in docs.items() if c}
    asked = {}
    for r in table(spark, DATA, "eval_queries").where("query_id % 20 = 0").collect():
        text = next((t for t in (r["clinical_context"], r["formatted_query"]) if t and t.strip()), None)
        asked |= {r["query_id"]: Counter(words(text))} if text else {}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    low = sum(idf.values()) / len(idf) / 4
    okapi = {t: low if x < 0 else x for t, x in idf.items()}
    smooth = {t: math.log((1 + n) / (1 + x)) + 1 for t, x in df.items()}
    norm = lambda c: math.sqrt(sum((f * smooth[t]) ** 2 for t, f in c.items() if t in smooth))
    score = lambda f: {q: {i: f(a, c) for i, c in docs.items() if a.keys() & c.keys()} for q, a in asked.items()}
    bm = best(score(lambda a, c: round(sum(x * okapi[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t, x in a.items() if t in c), 6)), 20)
    tf = best(score(lambda a, c: round(sum(x * c[t] * smooth[t] ** 2 for t, x in a.items() if t in c) / norm(a) / norm(c), 6)), 20)
    kb = best(score(lambda a, c: round(len(a.keys() & c.keys()) / math.sqrt(len(c)), 6)), 5)
    fused = {q: Counter() for q in asked}
    for lane, w in ((bm, 0.6), (tf, 0.4)):
        for q, x in lane.items():
            for r, (i, _) in enumerate(x, 1):
                fused[q][i] += w / (60 + r)
    fused = best({q: {i: round(s, 8) for i, s in x.items()} for q, x in fused.items()}, 10)
    for name, want, k, many in (("bm25_search_whole", bm, 10, lists), ("tfidf_search_whole", tf, 10, lists), ("hybrid_rrf_whole", fused, 10, lists), ("kb_overlap_whole", kb, 5, reports)):
        got = {(r["qid"], r["rank"]): r["score"] for r in many.QUERIES[name](spark, DATA).collect()}
        want = {(q, r): s for q, x in want.items() for r, (_, s) in enumerate(x[:k], 1)}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 3e-6 for x in got), name
    assert {r["qid"] for r in reports.QUERIES["alpha_fusion"](spark, DATA).collect()} == {q for q, x in bm.items() if x}


@needs_tables
def test_joins_cover_all_ids(spark):
    ids = lambda m, name, i: {r[0] for r in m.QUERIES[name](spark, DATA).select(i).distinct().collect()}
    labels = {r[0] for r in table(spark, DATA, "diagnosis_labels").where("diagnosis is not null").select("label_id").distinct().collect()}
    assert ids(relations, "entity_grade_qrels", "label_id") == labels
    assert any(i % 20 for i in ids(reports, "shared_words", "query_id"))


@needs_tables
def test_prototype_votes(spark):
    rows = table(spark, DATA, "embeddings").where("label is not null").collect()
    u = np.array([r["embedding"] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    labels = sorted({r["label"] for r in rows})
    p = np.array([u[[r["label"] == x for r in rows]].mean(0) for x in labels])
    e = np.exp(80 * (u @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T))
    want = {(r["vec_id"], x): w for r, ws in zip(rows, e / e.sum(1, keepdims=True)) for x, w in zip(labels, ws)}
    got = {(r["vec_id"], r["label"]): r["weight"] for r in texts.QUERIES["proto_vote_whole"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)
