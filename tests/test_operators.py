"""Small golden cases of the general operators."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import evaluation, incremental, ranking, relational, retrieval
from caseloom.sources import files
from caseloom.streaming import compaction


def test_ir_metrics_golden(spark):
    run = spark.createDataFrame([("q1", d, i + 1) for i, d in enumerate(["d1", "d3", "d5", "d2", "d6"])], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q1", "d1", 3), ("q1", "d2", 2), ("q1", "d3", 1), ("q2", "d1", 1)], "qid string, doc_id string, grade int")
    m = {r["qid"]: r for r in evaluation.retrieval_metrics(run, qrels, [3]).collect()}
    assert m["q1"]["mrr"] == 1.0 and abs(m["q1"]["recall_3"] - 2 / 3) < 1e-9 and abs(m["q1"]["precision_3"] - 2 / 3) < 1e-9 and abs(m["q1"]["ap"] - 11 / 12) < 1e-9
    assert m["q2"]["recall_3"] == 0 and m["q2"]["mrr"] == 0


def test_first_source_wins(spark):
    a = spark.createDataFrame([("k", 1)], "key string, v int")
    b = spark.createDataFrame([("k", 2), ("m", 3)], "key string, v int")
    out = relational.merge_sources([("a", a), ("b", b)], "key", ["v"]).collect()
    assert {(r["key"], r["v"], r["from_source"]) for r in out} == {("k", 1, "a"), ("m", 3, "b")}


def test_fusion_and_merge(spark):
    a = spark.createDataFrame([("q", "x", 1, 0.9), ("q", "y", 2, 0.5)], "qid string, doc_id string, rank int, score double")
    b = spark.createDataFrame([("q", "y", 1, 0.7)], "qid string, doc_id string, rank int, score double")
    f = {r["doc_id"]: r["score"] for r in ranking.reciprocal_rank_fusion([(a, 0.6), (b, 0.4)]).collect()}
    assert abs(f["y"] - (0.6 / 62 + 0.4 / 61)) < 1e-12
    m = {r["doc_id"]: (r["score"], r["via"]) for r in ranking.max_merge([("a", a, 1.0), ("b", b, 1.3)]).collect()}
    assert m["y"] == (pytest.approx(0.91), "b") and m["x"] == (0.9, "a")


def test_dense_blocks_match_one_block(spark):
    v = spark.range(300).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.hash(F.col("id"), i) % 100).cast("float")).alias("v"))
    q = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    rows = lambda b: sorted(map(tuple, retrieval.dense_top_k(v, q, 5, b).collect()))
    assert rows(4000) == rows(37) and len(rows(37)) == 75


def test_sentence_chunks_keep_every_sentence(spark):
    d = spark.createDataFrame([(1, "a b c. " * 50), (2, ""), (3, None), (4, "one")], "doc_id int, text string")
    out = retrieval.sentence_chunks(d, "doc_id", "text", 12).collect()
    assert sum(r["parts"] for r in out if r["doc_id"] == 1) == 50 and {r["doc_id"] for r in out} == {1, 4}
    assert all(r["tokens"] <= 12 for r in out)


def test_strict_readers(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k": 1}\n\nbroken\n{"k": 2}\n')
    assert files.read_jsonl(spark, str(p), "k int", "skip").where("k is not null").count() == 2
    assert files.read_jsonl(spark, str(p), "k int", "keep").where("bad_line is not null").count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "k int").collect()
    same = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, v int")
    assert files.unique_keyed(same, "key").count() == 2
    with pytest.raises(Exception):
        files.unique_keyed(same.union(spark.createDataFrame([("b", 3)], "key string, v int")), "key").collect()


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q", "d", 2, 0.123456)], "qid string, doc_id string, grade int, s double")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).first()["s"] == "0.1235"
    files.write_trec(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "q 0 d 2"
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 1
    (tmp_path / "ids.txt").write_text("b\n\na\nb\n")
    assert [(r["seq"], r["id"]) for r in files.read_id_list(spark, str(tmp_path / "ids.txt")).orderBy("seq").collect()] == [(1, "b"), (2, "a")]


def test_backfill_twice_changes_nothing(spark):
    df = spark.createDataFrame([("a", " "), ("b", "x"), ("c", None)], "k string, v string")
    once = incremental.filled(df, "v", F.lit("new"))
    assert sorted(map(tuple, incremental.filled(once, "v", F.lit("other")).collect())) == sorted(map(tuple, once.collect())) == [("a", "new"), ("b", "x"), ("c", "new")]


def test_stream_compaction_matches_batch(spark, tmp_path):
    rows = [("a", False, 5, "late"), ("a", True, 1, "ok"), ("b", False, 1, "x"), ("b", False, 2, "y"), ("c", True, 3, "p"), ("c", True, 3, "q")]
    source = tmp_path / "in"
    schema = "key string, ok boolean, at bigint, value string"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = {}

    def keep(df, _):
        got.update({r["key"]: (r["ok"], r["at"], r["value"]) for r in df.collect()})

    q = compaction.stream_compact(stream, "key", "ok", "at", "value").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
    q.processAllAvailable()
    q.stop()
    batch = incremental.compact(spark.createDataFrame(rows, schema), "key", [F.desc("ok"), F.desc("at"), F.desc("value")]).collect()
    assert got == {r["key"]: (r["ok"], r["at"], r["value"]) for r in batch}


def test_files_found_described_and_compared(spark, tmp_path):
    for name, text in (("r1/summary.json", '{"a": 1,\n "b": "x"}'), ("r2/summary.json", 'no\n{"a": 2}\n{"a": 3}\n'), ("r3/summary.json", "nothing"), ("r3/other.txt", "t")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    runs = {r["run"]: (r["a"], r["b"]) for r in files.read_run_catalog(spark, f"{tmp_path}/*/summary.json", "a int, b string").collect()}
    assert runs == {"r1": (1, "x"), "r2": (2, None)}
    assert sorted(r["name"] for r in files.discover(spark, str(tmp_path), "*.json").collect()) == ["summary.json"] * 3
    before = spark.createDataFrame(files.fingerprints(spark, str(tmp_path)).collect(), files.fingerprints(spark, str(tmp_path)).schema)
    (tmp_path / "r3/other.txt").write_text("u")
    (tmp_path / "r4.txt").write_text("new")
    (tmp_path / "r1/summary.json").unlink()
    change = {r["path"].rsplit("/", 1)[1]: r["change"] for r in files.changed_files(before, files.fingerprints(spark, str(tmp_path))).collect()}
    assert change == {"other.txt": "changed", "r4.txt": "added", "summary.json": "removed"}
    assert files.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/r4.txt"]) == f"{tmp_path}/r4.txt" and files.first_existing(spark, [f"{tmp_path}/none"], False) is None
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [f"{tmp_path}/none"])
    about, head = files.describe(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), 1)
    assert {r["column"]: (r["type"], r["filled"]) for r in about.collect()} == {"k": ("int", 2), "v": ("string", 1)} and head.count() == 1


def test_index_is_saved_and_loaded(spark, tmp_path):
    from caseloom.functions import text as T

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id int, text string")
    p = retrieval.postings(docs, "doc_id", T.tokens(F.col("text")))
    files.save_index(p, f"{tmp_path}/index")
    assert sorted(map(tuple, files.load_index(spark, f"{tmp_path}/index").select(*p.columns).collect())) == sorted(map(tuple, p.collect()))


def test_recall_of_given_indices(spark):
    rows = [(["A", "B", "C"], [1, 3, 99]), (["A"], [1, 1, None, 0]), ([], [1]), (None, None)]
    out = evaluation.recall_of_indices(spark.createDataFrame(rows, "p array<string>, i array<int>"), "p", "i").collect()
    assert [(r["matched"], r["total"], r["unmatched"]) for r in out] == [(2, 3, ["B"]), (1, 1, []), (0, 0, []), (0, 0, [])]
    assert out[0]["recall"] == pytest.approx(2 / 3) and out[2]["recall"] == 0


def test_diverse_texts_like_brute_force(spark):
    rows = [("q", f"d{i}", 1.0 - i / 100, t) for i, t in enumerate(["a b c d e", "A b c d e", "a b c d e f", "x y", None, "x y z", ""])]
    got = [(r["doc_id"], r["place"]) for r in ranking.diverse_texts(spark.createDataFrame(rows, "qid string, doc_id string, score double, text string"), 5, 0.8).orderBy("place").collect()]
    assert got == [("d0", 1), ("d3", 2), ("d4", 3), ("d5", 4), ("d6", 5)]
    few = ranking.diverse_texts(spark.createDataFrame(rows[:3], "qid string, doc_id string, score double, text string"), 3, 0.5).orderBy("place").collect()
    assert [r["doc_id"] for r in few] == ["d0", "d1", "d2"]


def test_folds_share_out_every_stratum(spark):
    from caseloom.operators import sampling

    rows = spark.createDataFrame([(i, "a" if i < 900 else "b" if i < 960 else "rare") for i in range(965)], "k int, s string")
    n = {(r["stratum"], r["fold"]): r["count"] for r in sampling.stratified_folds(rows, "k", "s", 5, 30).groupBy("stratum", "fold").count().collect()}
    assert all(abs(n["a", f] - 180) <= 16 for f in range(5)) and sum(v for (s, _), v in n.items() if s == "merged") == 5


def test_running_totals_like_one_window(spark):
    rows = [(i * 7 % 1000, i % 13) for i in range(1000)]
    got = {r["v"]: r["ahead"] for r in ranking.running_totals(spark.createDataFrame(rows, "v int, n int"), ["v"], F.col("n")).collect()}
    total, want = 0, {}
    for v, n in sorted(rows):
        want[v] = total
        total += n
    assert got == want and ranking.running_totals(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_run_folder_is_deleted(spark):
    import os

    from caseloom import session

    with session.run_folder(spark) as path:
        assert session.written(spark.range(5), "x").count() == 5 and os.listdir(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:")) and session.written(spark.range(3)).count() == 3
