"""Search lanes over documents and vectors: postings, cosine, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators.ranking import ranked
from caseloom.session import spread, written

Weigh = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, dl, term, tf)`` of ``(doc_id, t)``, each row counted by itself."""
    for batch in batches:
        t = batch.column("t")
        sizes = pc.list_value_length(t).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = t.flatten().dictionary_encode()
        if not len(words):
            continue
        row = np.repeat(np.arange(len(sizes)), sizes)
        kinds = len(words.dictionary)
        pair, tf = np.unique(row * np.int64(kinds) + words.indices.to_numpy(), return_counts=True)
        row, term = pair // kinds, pair % kinds
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(sizes[row].astype(np.int32)), words.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64))], ["doc_id", "dl", "term", "tf"])


def postings(documents: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """``(term, doc_id, dl, tf)``: the inverted index with document lengths.

    Terms are counted row by row, without a shuffle; only rows of one id and
    length, where ids repeat, are added up.
    """
    d = spread(documents).select(F.col(id_col).alias("doc_id"), terms.alias("t"))
    kind = d.schema["doc_id"].dataType.simpleString()
    count = lambda rows: rows.mapInArrow(_term_counts, f"doc_id {kind}, dl int, term string, tf bigint").select("term", "doc_id", "dl", "tf")
    again = documents.groupBy(F.col(id_col).alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"))
    if again.isEmpty():
        return count(d)
    again = written(again, "repeated-ids")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    summed = count(d.join(again, same, "left_semi")).groupBy("term", "doc_id", "dl").agg(F.sum("tf").alias("tf"))
    return count(d.join(again, same, "left_anti")).unionByName(summed)


def asked_postings(index: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Rows of the index whose term is asked for, together by document, so that sums over them are not shuffled again."""
    return index.join(query_terms.select("term").distinct(), "term", "left_semi").repartition("doc_id")


def bm25(index: DataFrame, query_terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(qid, doc_id, score)`` for ``query_terms(qid, term, qtf)``.

    Okapi weights; a negative idf becomes a quarter of the mean idf. Terms are
    joined with their postings and summed, so only documents that share a term
    are touched; the statistics are aggregates of the whole index.
    """
    lengths = index.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    df = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = df.withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", "avg_dl", F.when(F.col("idf") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    asked = written(query_terms.join(idf, "term"), "asked")
    weighted = asked_postings(index, asked).join(asked, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return weighted.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")


def tf_idf(index: DataFrame, query_terms: DataFrame, broadcast_terms: int = 1_000_000) -> DataFrame:
    """``(qid, doc_id, score)``: cosine of smoothed tf-idf vectors.

    A vocabulary of at most ``broadcast_terms`` is sent to all tasks instead of
    shuffling the postings by term.
    """
    stats = index.agg(F.count_distinct("doc_id").alias("n_docs"))
    idf = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    idf = written(idf, "idf")
    d = index.join(F.broadcast(idf) if idf.count() <= broadcast_terms else idf, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("w"))
    dn = d.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    q = query_terms.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    asked = written(q.join(qn, "qid"), "asked")
    dots = asked_postings(d, asked).join(dn, "doc_id").join(asked, "term").groupBy("qid", "doc_id", "qn", "dn").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.select("qid", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def overlap(index: DataFrame, query_terms: DataFrame) -> DataFrame:
    """``(qid, doc_id, score)``: terms shared with a query over the root of a document's number of terms."""
    n = index.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = written(query_terms.select("qid", "term"), "asked")
    shared = asked_postings(index, asked).join(n, "doc_id").join(asked, "term").groupBy("qid", "doc_id", "n").agg(F.count("*").alias("c"))
    return shared.select("qid", "doc_id", (F.col("c") / F.sqrt("n")).alias("score"))


def once_each(query_terms: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of ``query_terms(qid, term, qtf)``, run once for the queries with the same terms.

    The smallest id asks for all of them; its list is then given to each.
    """
    bags = written(query_terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("bag")), "bags")
    first = written(bags.groupBy("bag").agg(F.min("qid").alias("head")), "first-of-bags")
    found = search(first.select(F.col("head").alias("qid"), F.explode("bag").alias("x")).select("qid", "x.term", "x.qtf"))
    return bags.join(first, "bag").select("qid", "head").join(found.withColumnRenamed("qid", "head"), "head").drop("head")


def _packed(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """``rows(key, v)`` dealt by hash into arrays of about ``block_rows``."""
    blocks = max(1, -(-rows.count() // block_rows))
    entry = F.struct(F.col(key), F.col("v").cast("array<double>").alias("v"))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(F.collect_list(entry).alias("rows")).drop("block")


def _unit_rows(rows: list) -> np.ndarray:
    m = np.stack([np.asarray(r["v"], float) for r in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4_000, exclude_self: bool = True) -> DataFrame:
    """``(qid, doc_id, score, rank)``: exact cosine top k of every query vector.

    ``vectors(doc_id, v)`` and the stated ``queries(qid, v)`` are packed into
    blocks; every block of queries meets every block of vectors in one matrix
    product, and k rows per query and block go on to the final ranking. Scores
    are rounded to nine places, ties go to the smaller id.
    """
    kind_q, kind_d = queries.schema["qid"].dataType.simpleString(), vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for docs, asked in zip(batch["docs"], batch["asked"]):
                ids, qids = np.array([r["doc_id"] for r in docs]), np.array([r["qid"] for r in asked])
                scores = np.round(_unit_rows(asked) @ _unit_rows(docs).T, 9)
                if exclude_self:
                    scores[qids[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, 1)
                keep = np.isfinite(best).ravel()
                yield pd.DataFrame({"qid": np.repeat(qids, order.shape[1])[keep], "doc_id": ids[order.ravel()][keep], "score": best.ravel()[keep]})

    pairs = _packed(vectors, "doc_id", block_rows).withColumnRenamed("rows", "docs").crossJoin(_packed(queries, "qid", block_rows).withColumnRenamed("rows", "asked"))
    return ranked(pairs.mapInPandas(run, f"qid {kind_q}, doc_id {kind_d}, score double"), k)


Index = tuple[np.ndarray, ...]


def _lexical_postings(vocabulary: np.ndarray, edges: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int) -> Index:
    """The postings of a block of documents by term, and again by document: terms, weights and where each document begins and ends."""
    order = np.argsort(doc.astype(np.int16) if n_docs < 2**15 else doc, kind="stable")
    term = np.repeat(np.arange(len(vocabulary), dtype=np.int32), np.diff(edges))
    return vocabulary, edges, doc, weight, term[order], weight[order], np.append(0, np.cumsum(np.bincount(doc, minlength=n_docs)))


def _lexical_index(ids: np.ndarray, sizes: np.ndarray, norms: np.ndarray, terms: np.ndarray, weigh: Weigh) -> Index:
    """Terms of a block of documents, where the postings of each begin and end, and their documents and weights."""
    doc = np.repeat(np.arange(len(ids)), sizes)
    vocabulary, term = np.unique(terms, return_inverse=True)
    pair, tf = np.unique(term * np.int64(len(ids)) + doc, return_counts=True)
    term, doc = pair // len(ids), pair % len(ids)
    held = np.bincount(doc, minlength=len(ids))
    return _lexical_postings(vocabulary, np.searchsorted(term, np.arange(len(vocabulary) + 1)), doc, weigh(tf, sizes[doc], held[doc], norms[doc]), len(ids))


def _best(row: np.ndarray, score: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Places of the scores above zero that are among the ``k`` best of their row, ties included; ``least`` is raised to the k-th score."""
    order = np.lexsort((-score, row))
    order = order[score[order] > 0]
    at = np.searchsorted(row[order], np.arange(len(least)))
    kth = at + k - 1
    full = kth < np.append(at, len(order))[1:]
    least[full] = np.maximum(least[full], score[order[kth[full]]])
    return order[score[order] >= least[row[order]]]


def _lexical_block(n_docs: int, index: Index, asked: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, dense: float = 0.0015, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the scores above zero that are among the ``k`` best of a query, ties included, and the scores.

    All pairs are scored in single precision; those that its error bound cannot
    part from the ``k`` best, or from a score of ``least``, are summed again in
    double precision and rounded. Of the first sums, terms that more than a
    share of ``dense`` of all pairs of query and document have in common are
    one matrix product (1,024 terms at most), the others go term by term.
    """
    q_sizes, q_terms, q_w = asked
    known, edges, doc, weight, d_term, d_weight, d_edges = index
    n_q = len(q_sizes)
    least = np.full(n_q, -np.inf) if least is None else least
    vocabulary, term = np.unique(q_terms, return_inverse=True)
    order = np.argsort(term, kind="stable")
    q_of, w_of = np.repeat(np.arange(n_q), q_sizes)[order], q_w[order]
    q_edges = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    _, mine, its = np.intersect1d(vocabulary, known, assume_unique=True, return_indices=True)
    if not len(mine):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    q_a, q_b, d_a, d_b = q_edges[mine], q_edges[mine + 1], edges[its], edges[its + 1]
    shared = (q_b - q_a) * (d_b - d_a)
    often = shared > dense * n_q * n_docs
    often[np.argsort(-shared, kind="stable")[1024:]] = False

    single = weight.astype(np.float32)
    left, right = np.zeros((n_q, int(often.sum())), np.float32), np.zeros((int(often.sum()), n_docs), np.float32)
    for i, (a, b, c, d) in enumerate(zip(q_a[often].tolist(), q_b[often].tolist(), d_a[often].tolist(), d_b[often].tolist())):
        left[q_of[a:b], i] = w_of[a:b]
        right[i, doc[c:d]] = single[c:d]
    scores = left @ right
    for a, b, c, d in zip(q_a[~often].tolist(), q_b[~often].tolist(), d_a[~often].tolist(), d_b[~often].tolist()):
        scores[q_of[a:b][:, None], doc[c:d]] += w_of[a:b, None].astype(np.float32) * single[c:d]

    slot = np.full(len(vocabulary), -1)
    slot[mine] = np.arange(len(mine))
    q_slot = slot[np.repeat(np.arange(len(vocabulary)), np.diff(q_edges))]
    known_too = q_slot >= 0
    q_slot, q_of, w_of = q_slot[known_too], q_of[known_too], w_of[known_too]
    most = np.maximum.reduceat(np.abs(weight), edges[:-1])[its]
    error = 1e-6 + (len(mine) + 8) * 2.0**-23 * np.bincount(q_of, weights=np.abs(w_of) * most[q_slot], minlength=n_q)
    reach = least - error
    new = np.isneginf(reach)
    if n_docs > k and new.any():
        reach[new] = np.partition(scores[new], n_docs - k, axis=1)[:, n_docs - k] - 2 * error[new]
    signed = bool((w_of < 0).any() or (weight < 0).any())
    reach = np.maximum(reach, -error if signed else np.finfo(np.float32).tiny)
    row, column = np.divmod(np.flatnonzero((scores >= np.nextafter(reach.astype(np.float32), np.float32(-np.inf))[:, None]).ravel()), n_docs)

    d_slot = np.full(len(known), len(mine), np.int32)  # terms that are not asked for have weight 0, in the last column
    d_slot[its] = np.arange(len(mine))
    by_row = np.argsort(q_of, kind="stable")
    q_slot, q_of, w_of = q_slot[by_row], q_of[by_row], w_of[by_row]
    held, exact, rows = np.diff(d_edges), np.zeros(len(row)), max(1, 4_000_000 // (len(mine) + 1))
    for a in range(0, n_q, rows):
        b = min(n_q, a + rows)
        (first, last), (i, j) = np.searchsorted(row, (a, b)), np.searchsorted(q_of, (a, b))
        wide = np.zeros((b - a, len(mine) + 1))
        wide[q_of[i:j] - a, q_slot[i:j]] = w_of[i:j]
        for x in range(first, last, 8192):
            r, c = row[x : min(last, x + 8192)], column[x : min(last, x + 8192)]
            begins = np.append(0, np.cumsum(held[c]))
            at = np.repeat(d_edges[c] - begins[:-1], held[c]) + np.arange(begins[-1])
            exact[x : x + len(r)] = np.add.reduceat(wide[np.repeat(r - a, held[c]), d_slot[d_term[at]]] * d_weight[at], begins[:-1])
    exact = np.round(exact, 6)
    best = _best(row, exact, k, least.copy())
    return row[best], column[best], exact[best]


def lexical_top_k(documents: DataFrame, asked: DataFrame, k: int, weigh: Weigh, block_rows: int = 8_000, query_rows: int = 1_000) -> DataFrame:
    """``(qid, doc_id, score, rank)``: exact top k of every query of ``asked(qid, term, w)`` over ``documents(doc_id, t, norm)``.

    The score is the sum over shared terms of w times ``weigh(tf, length,
    distinct terms, norm)``, rounded to six places; ties go to the smaller id
    and scores of 0 are left out. Documents are indexed once in blocks. A block
    of four times ``query_rows`` queries meets the blocks of documents one
    after the other and keeps its best so far, whose last score the next block
    must reach; so the joined postings, of which there are far more than
    documents, are summed inside a task and never shuffled, and k rows a query
    leave it for every 16 blocks of documents. Terms are compared by 64-bit
    hashes; each query and term occurs once.
    """
    kind_q, kind_d = asked.schema["qid"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    d = written(spread(documents).select("doc_id", F.coalesce("norm", F.lit(0.0)).alias("norm"), F.transform("t", lambda x: F.xxhash64(x)).alias("t")).where(F.size("t") > 0), "lexical-documents")
    q = written(asked.groupBy("qid").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))).alias("q")), "lexical-queries")
    whole = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
    packed = lambda *xs: [pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for x, kind in xs]
    sizes_of = lambda column: pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, t = batch.column("doc_id"), batch.column("t")
                known, edges, doc, weight, *_ = _lexical_index(ids, sizes_of(t), batch.column("norm").to_numpy(zero_copy_only=False), t.flatten().to_numpy(zero_copy_only=False), weigh)
                yield pa.RecordBatch.from_arrays([whole(ids), *packed((known, np.int64), (edges, np.int64), (doc, np.int32), (weight, np.float64))], ["ids", "known", "edges", "doc", "weight"])

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("q").flatten()
                yield pa.RecordBatch.from_arrays([whole(batch.column("qid")), *packed((sizes_of(batch.column("q")), np.int64), (x.field("t"), np.int64), (x.field("w"), np.float64))], ["qids", "q_sizes", "q_terms", "q_w"])

    docs = written(d.repartition(max(1, -(-d.count() // block_rows)), "doc_id").mapInArrow(indexed, f"ids array<{kind_d}>, known binary, edges binary, doc binary, weight binary"), "lexical-index")
    blocks = max(q.sparkSession.sparkContext.defaultParallelism, -(-q.count() // (4 * query_rows)))
    queries = q.repartition(blocks, "qid").mapInArrow(collected, f"qids array<{kind_q}>, q_sizes binary, q_terms binary, q_w binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, row, score, found, least = None, np.zeros(0, int), np.zeros(0), None, np.zeros(0)
        out = lambda: pa.RecordBatch.from_arrays([qids.take(pa.array(row)), found, pa.array(score)], ["qid", "doc_id", "score"])
        for batch in batches:
            for n in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[n].as_buffer(), kind)  # noqa: B023, E731
                mine, ids = batch.column("qids")[n].values, batch.column("ids")[n].values
                if qids is None or not mine[0].equals(qids[0]):  # each query is in one block
                    if qids is not None:
                        yield out()
                    qids, row, score, found, least = mine, np.zeros(0, int), np.zeros(0), ids[:0], np.full(len(mine), -np.inf)
                index = _lexical_postings(read("known", np.int64), read("edges", np.int64), read("doc", np.int32), read("weight", np.float64), len(ids))
                q_sizes, q_terms, q_w = read("q_sizes", np.int64), read("q_terms", np.int64), read("q_w", np.float64)
                at, new = np.append(0, np.cumsum(q_sizes)), []
                for a in range(0, len(mine), query_rows):
                    b = min(len(mine), a + query_rows)
                    r, column, s = _lexical_block(len(ids), index, (q_sizes[a:b], q_terms[at[a] : at[b]], q_w[at[a] : at[b]]), k, least=least[a:b])
                    new.append((r + a, column, s))
                row, score = np.concatenate([row, *[x[0] for x in new]]), np.concatenate([score, *[x[2] for x in new]])
                found = pa.concat_arrays([found, ids.take(pa.array(np.concatenate([x[1] for x in new])))])
                best = _best(row, score, k, least)
                row, score, found = row[best], score[best], found.take(pa.array(best))
        if qids is not None:
            yield out()

    pairs = queries.hint("shuffle_replicate_nl").crossJoin(docs.coalesce(max(1, -(-docs.count() // 16))))
    return ranked(pairs.mapInArrow(run, f"qid {kind_q}, doc_id {kind_d}, score double"), k)


def lexical_statistics(documents: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """``(term, df)`` of ``documents(doc_id, t)``, and their number and mean length."""
    d = documents.where(F.size("t") > 0)
    n = d.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"), F.sum(F.size(F.array_distinct("t"))).alias("terms")).first()
    df = d.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df, {"n": float(n["n"] or 0), "mean": float(n["mean"] or 1)}


def bm25_top_k(documents: DataFrame, query_terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``bm25`` of ``documents(doc_id, t)`` in blocks."""
    df, n = lexical_statistics(documents)
    idf = written(df.withColumn("idf", F.log(F.lit(n["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
    low = 0.25 * float(idf.agg(F.avg("idf").alias("m")).first()["m"] or 0.0)
    asked = query_terms.join(idf, "term").select("qid", "term", (F.col("qtf") * F.when(F.col("idf") < 0, low).otherwise(F.col("idf"))).alias("w"))
    mean = n["mean"]
    return lexical_top_k(documents.withColumn("norm", F.lit(0.0)), asked, k, lambda tf, length, held, norm: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))


def tf_idf_top_k(documents: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """``tf_idf`` of ``documents(doc_id, t)`` in blocks."""
    df, n = lexical_statistics(documents)
    idf = written(df.select("term", (F.log((1.0 + n["n"]) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "idf")
    tf = documents.select("doc_id", F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    norm = tf.join(idf, "term").groupBy("doc_id").agg((1 / F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2))))).alias("norm"))
    q = query_terms.join(idf, "term").withColumn("x", F.col("qtf") * F.col("idf"))
    asked = q.join(q.groupBy("qid").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("qn")), "qid").select("qid", "term", (F.col("x") * F.col("idf") / F.col("qn")).alias("w"))
    return lexical_top_k(documents.join(norm, "doc_id"), asked, k, lambda tf, length, held, norm: tf * norm)


def overlap_top_k(documents: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """Terms shared with a query over the root of a document's number of terms, in blocks."""
    asked = query_terms.select("qid", "term", F.lit(1.0).alias("w"))
    return lexical_top_k(documents.withColumn("norm", F.lit(0.0)), asked, k, lambda tf, length, held, norm: 1 / np.sqrt(held))


def fixed_chunks(documents: DataFrame, id_col: str, text: str, max_words: int = 307, overlap: int = 38) -> DataFrame:
    """``(doc_id, chunk, words, chunk_text)``: word windows that overlap.

    The last window ends with the text; blank texts have none.
    """
    step = max_words - overlap
    w = documents.select(F.col(id_col).alias("doc_id"), F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "").alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - max_words) / F.lit(float(step))).cast("int"))
    at = w.select("doc_id", "_w", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.slice(F.col("_w"), F.col("chunk") * step + 1, F.lit(max_words))
    return at.select("doc_id", "chunk", F.size(part).alias("words"), F.array_join(part, " ").alias("chunk_text"))


def _packed_parts(documents: DataFrame, id_col: str, parts: Column, budget: int) -> DataFrame:
    s = documents.select(F.col(id_col).alias("doc_id"), parts.alias("_s")).where(F.size("_s") > 0)
    start = F.expr("named_struct('done', cast(array() as array<struct<parts:int,tokens:bigint>>), 'n', 0, 'sum', cast(0 as bigint))")
    whole = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["n"].alias("parts"), acc["sum"].alias("tokens"))))

    def step(acc: Column, x: Column) -> Column:
        t = T.token_estimate(x)
        full = (acc["n"] > 0) & (acc["sum"] + t > budget)
        return F.struct(
            F.when(full, whole(acc)).otherwise(acc["done"]).alias("done"), F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.when(full, t).otherwise(acc["sum"] + t).alias("sum")
        )

    return s.select("doc_id", F.posexplode(F.aggregate("_s", start, step, whole)).alias("chunk", "_c")).select("doc_id", "chunk", "_c.parts", "_c.tokens")


def sentence_chunks(documents: DataFrame, id_col: str, text: str, budget: int = 400) -> DataFrame:
    """``(doc_id, chunk, parts, tokens)``: sentences packed greedily to a token budget.

    A sentence over the budget is a chunk of its own. The fold runs inside the
    row, as an aggregate over its array of sentences.
    """
    return _packed_parts(documents, id_col, T.sentences(F.col(text)), budget)


def paragraph_chunks(documents: DataFrame, id_col: str, text: str, budget: int = 400) -> DataFrame:
    """The same with paragraphs, which blank lines part; none is split."""
    return _packed_parts(documents, id_col, F.filter(F.split(F.col(text), r"\n\s*\n"), lambda p: F.trim(p) != ""), budget)
