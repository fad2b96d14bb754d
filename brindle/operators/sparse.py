"""The sparse arm: a global TF-IDF index as two tables, and keyword search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import let, sparse_tokens
from brindle.operators.dense import best_pairs
from brindle.operators.ranking import SCORE_DIGITS, small_side, top_k
from brindle.sources.scratch import saved

#: Terms of a batch of queries that are named to the scan.
PUSHED_TERMS = 400
#: Queries in a block, rows of documents that are scored against a block at once, and bytes of all blocks that may be
#: sent to every task; more are joined with the documents block by block.
QUERY_BLOCK = 1024
SCORE_ROWS = 2048
MAX_QUERY_BYTES = 64 << 20
#: A term goes to the matrix product where more than one in so many pairs of a block share it.
DENSE_SHARE = 256
#: Terms whose weights are sent to every task; what rarer ones add to the norms of documents is joined.
TERMS_SENT = 2_000_000


def term_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf): counts are combined on the map side."""
    return docs.select(F.col(key), F.explode(sparse_tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit_vocabulary(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf) over the whole corpus: ln((1 + N) / (1 + df)) + 1."""
    return counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + F.lit(n_docs)) / (1.0 + F.col("df"))) + 1.0)


def weighted_rows(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, terms, ws): tf times idf of each document's terms, to unit length. Terms outside the vocabulary drop out."""
    raw = counts.join(vocabulary.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    each = raw.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda total, x: total + x["w"] * x["w"]))
    return each.select(key, F.col("p.term").alias("terms"), let(norm, lambda n: F.transform("p", lambda x: x["w"] / n)).alias("ws"))


def postings_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, term, w) of weighted rows."""
    return rows.select(key, F.explode(F.arrays_zip("terms", "ws")).alias("p")).select(key, F.col("p.terms").alias("term"), F.col("p.ws").alias("w"))


def weigh(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, w): tf times idf, each document to unit length. Terms outside the vocabulary drop out."""
    return postings_of(weighted_rows(counts, vocabulary, key), key)


def keyword_scores(postings: DataFrame, query_weights: DataFrame, key: str = "key") -> DataFrame:
    """(qid, key, score): cosine over shared terms. The queries' side is broadcast if its rows are few, so
    postings are read once and partial sums are combined before the shuffle."""
    q = small_side(query_weights.select("qid", "term", F.col("w").alias("wq")))
    return postings.join(q, "term").groupBy("qid", key).agg(F.sum(F.col("w") * F.col("wq")).alias("score"))


def search(postings: DataFrame, vocabulary: DataFrame, queries: DataFrame, k: int, key: str = "key") -> DataFrame:
    """(qid, key, score, rank) of `queries(qid, query)` over stored postings and vocabulary. Where the queries
    have few terms, these are pushed into the scan: postings are clustered by term, so most row groups
    are skipped. A query with no known term has no hit."""
    counts = term_counts(queries, "qid", F.col("query"))
    terms = [r["term"] for r in counts.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(terms) <= PUSHED_TERMS:
        postings, vocabulary = postings.where(F.col("term").isin(terms)), vocabulary.where(F.col("term").isin(terms))
    return top_k(keyword_scores(postings, weigh(counts, vocabulary, "qid"), key), k, ["qid"], key=key)


def block_scores(asked: tuple, found: tuple) -> np.ndarray:
    """Scores of queries (rows) by documents (columns), both given as (starts, term ids, weights); -1 where they
    share no term. Frequent terms go through a matrix product, the others pair by pair."""
    (q_at, q_term, q_w), (d_at, d_term, d_w) = asked, found
    nq, nd = len(q_at) - 1, len(d_at) - 1
    terms, q_of = np.unique(q_term, return_inverse=True)
    q_row, d_row = np.repeat(np.arange(nq), np.diff(q_at)), np.repeat(np.arange(nd), np.diff(d_at))
    d_of = np.searchsorted(terms, d_term)
    known = np.flatnonzero(d_of < len(terms))
    known = known[terms[d_of[known]] == d_term[known]]
    d_of, d_row, d_w = d_of[known], d_row[known], d_w[known]
    q_n, d_n = np.bincount(q_of, minlength=len(terms)), np.bincount(d_of, minlength=len(terms))
    often = q_n * d_n * DENSE_SHARE > nq * nd
    place = np.cumsum(often) - 1
    x, y = np.zeros((nq, int(often.sum()))), np.zeros((int(often.sum()), nd))
    pick, mine = often[q_of], often[d_of]
    x[q_row[pick], place[q_of[pick]]] = q_w[pick]
    y[place[d_of[mine]], d_row[mine]] = d_w[mine]
    score = x @ y
    rest = np.flatnonzero(~mine)
    order = np.argsort(np.where(pick, len(terms), q_of), kind="stable")[: len(pick) - int(pick.sum())]
    first = np.searchsorted(q_of[order], np.arange(len(terms)))
    times = q_n[d_of[rest]]
    at = np.repeat(first[d_of[rest]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    entry, doc = order[at], np.repeat(rest, times)
    score += np.bincount(q_row[entry] * nd + d_row[doc], q_w[entry] * d_w[doc], nq * nd).reshape(nq, nd)
    return np.where(score > 0, np.round(score, SCORE_DIGITS), -1.0)


def _ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, ids, ws): terms as 64-bit hashes; two of a million terms share one with a chance of 1 in 30 million."""
    return rows.select(key, F.transform("terms", lambda t: F.xxhash64(t)).alias("ids"), "ws")


def _flat(b: pa.RecordBatch, ids: int, ws: int) -> tuple:
    sizes = pc.list_value_length(b.column(ids)).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes)).astype(np.int64), b.column(ids).flatten().to_numpy(), b.column(ws).flatten().to_numpy()


def _packed(rows: DataFrame, key: str, size: int, names: list[str]) -> DataFrame:
    """Blocks of (key, ids, ws): keys, starts, ids and weights, so that a block is one row of a join."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                some = b.slice(at, size)
                parts = _flat(some, 1, 2)
                ends = pa.array([0, some.num_rows], pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(ends, some.column(0)), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

    return rows.mapInArrow(run, f"{names[0]} array<{kind}>, " + ", ".join(f"{n} binary" for n in names[1:]))


def block_search(rows: DataFrame, vocabulary: DataFrame, queries: DataFrame, k: int, key: str = "key") -> DataFrame:
    """As `search`, for queries of many terms, over weighted rows: blocks of queries meet blocks of documents, and a
    pair of blocks passes on its own k best for each query. Pairs of a query and a document are never shuffled."""
    counts = term_counts(queries, "qid", F.col("query"))
    asked = _ids(weighted_rows(counts, vocabulary, "qid"), "qid")
    docs = _packed(_ids(rows, key), key, SCORE_ROWS, ["keys", "d_starts", "d_ids", "d_ws"])
    return _meet(docs, _query_blocks(asked, queries.count()), k, key, rows.schema[key].dataType.simpleString(), queries.schema["qid"].dataType.simpleString())


def _query_blocks(asked: DataFrame, n: int) -> DataFrame:
    return saved(_packed(asked.repartition(max(1, -(-n // QUERY_BLOCK)), "qid"), "qid", QUERY_BLOCK, ["qids", "q_starts", "q_ids", "q_ws"]), "blocks")


def _meet(docs: DataFrame, blocks: DataFrame, k: int, key: str, key_type: str, qid_type: str) -> DataFrame:
    """(qid, key, score, rank): the k best of packed documents for the queries of blocks."""
    size = blocks.agg(F.coalesce(F.sum(F.length("q_ids") + F.length("q_ws")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                keys, qids = b.column(0).slice(r, 1).flatten(), b.column(4).slice(r, 1).flatten()
                found, asked = ((np.frombuffer(b.column(c)[r].as_py(), np.int64), np.frombuffer(b.column(c + 1)[r].as_py(), np.int64), np.frombuffer(b.column(c + 2)[r].as_py())) for c in (1, 5))
                order = np.empty(len(keys), np.int64)
                order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                score = block_scores(asked, found)
                i, j = best_pairs(score, order, k)
                hit = score[i, j] >= 0
                i, j = i[hit], j[hit]
                yield pa.record_batch([qids.take(pa.array(i)), keys.take(pa.array(j)), pa.array(score[i, j])], names=["qid", key, "score"])

    pairs = docs.crossJoin(F.broadcast(blocks) if size <= MAX_QUERY_BYTES else blocks)  # blocks of a stated query set against all blocks of rows
    return top_k(pairs.mapInArrow(run, f"qid {qid_type}, `{key}` {key_type}, score double"), k, ["qid"], key=key)


def _term_ids(text: Column) -> Column:
    """The tokens of a text as 64-bit hashes (see `_ids`), repeats included; of null, none."""
    return F.coalesce(F.transform(sparse_tokens(text), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))


def _texts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, text), one row a key: the texts of a key that occurs again count as one document, as in `term_counts`."""
    rows = docs.select(key, text.alias("text"))
    if docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def text_vocabulary(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(id, df, idf) of hashed terms, saved. Terms are counted where the texts are: pairs of a document and a term
    are neither shuffled nor written."""
    ids = _texts(docs, key, text).select(F.explode(F.array_distinct(_term_ids(F.col("text")))).alias("id"))
    return saved(fit_vocabulary(ids.withColumnRenamed("id", "term"), docs.count()).withColumnRenamed("term", "id"), "terms")


def text_search(docs: DataFrame, vocabulary: DataFrame, queries: DataFrame, k: int, key: str, text: Column) -> DataFrame:
    """As `search`, without an index: over the texts themselves, with the vocabulary of `text_vocabulary`. Each task
    weighs its texts by the vocabulary that is sent to it, and passes on the terms that a query has. Of a vocabulary
    beyond TERMS_SENT the most frequent terms and those of the queries are sent; only pairs with the others are
    shuffled, for the norms."""
    spark, n = docs.sparkSession, queries.count()
    counts = queries.select("qid", F.explode(_term_ids(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"))
    asked = saved(weighted_rows(counts, vocabulary.withColumnRenamed("id", "term"), "qid").select("qid", F.col("terms").alias("ids"), "ws"), "asked")
    wanted = asked.select(F.explode("ids").alias("id")).distinct().withColumn("wanted", F.lit(True))
    known = vocabulary.join(wanted, "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    least, total = 1, 0
    for r in sorted(vocabulary.groupBy("df").count().collect(), reverse=True):  # few: m different counts take m * m / 2 pairs
        total += r["count"]
        if total > TERMS_SENT:
            least = r["df"] + 1
            break
    sent = known.where((F.col("df") >= least) | F.col("wanted")).select("id", "idf", "wanted").toArrow()
    place = np.argsort(sent["id"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(sent[c].to_numpy()[place] for c in ("id", "idf", "wanted")))

    def found(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids in the table, and which are there."""
        at = np.minimum(np.searchsorted(table.value[0], ids), max(0, len(table.value[0]) - 1))
        return at, table.value[0][at] == ids if len(table.value[0]) else np.zeros(len(ids), bool)

    texts = _texts(docs, key, text)
    kind = texts.schema[key].dataType.simpleString()
    rest = F.lit(0.0)
    if least > 1:
        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = pa.array(~found(b.column(1).to_numpy())[1])
                yield b.filter(keep)

        pairs = texts.select(key, F.explode(_term_ids(F.col("text"))).alias("id")).mapInArrow(others, f"`{key}` {kind}, id bigint")
        weights = pairs.groupBy(key, "id").agg(F.count("*").alias("tf")).join(vocabulary.select("id", "idf"), "id")
        norms = saved(weights.groupBy(key).agg(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0))).alias("rest")), "norms")
        texts, rest = texts.join(norms, key, "left"), F.coalesce("rest", F.lit(0.0))

    def weigh_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, wanted = table.value
        for b in batches:
            for at in range(0, b.num_rows, SCORE_ROWS):
                some = b.slice(at, SCORE_ROWS)
                m = some.num_rows
                ids = some.column(1).flatten().to_numpy()
                row = np.repeat(np.arange(m), pc.list_value_length(some.column(1)).to_numpy())
                term, there = found(ids)
                pair, tf = np.unique(row[there] * max(1, len(terms)) + term[there], return_counts=True)
                row, term = np.divmod(pair, max(1, len(terms)))
                w = tf * idf[term]
                norm = np.sqrt(np.bincount(row, w * w, m) + some.column(2).to_numpy())
                keep = wanted[term]
                row, term, w = row[keep], term[keep], w[keep]
                starts = np.append(0, np.cumsum(np.bincount(row, minlength=m))).astype(np.int64)
                parts = starts, terms[term], w / norm[row]
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, m], pa.int32()), some.column(0)), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["keys", "d_starts", "d_ids", "d_ws"])

    packed = texts.select(key, _term_ids(F.col("text")).alias("ids"), rest.alias("rest")).mapInArrow(weigh_texts, f"keys array<{kind}>, d_starts binary, d_ids binary, d_ws binary")
    return _meet(packed, _query_blocks(asked, n), k, key, kind, queries.schema["qid"].dataType.simpleString())


def keyword_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "key", text: str = "text", query: str = "query") -> DataFrame:
    """Fit, and search `queries(qid, query)`: (qid, key, score, rank). A query with no known term has no
    hit."""
    counts = term_counts(docs, key, F.col(text))
    vocabulary = fit_vocabulary(counts, docs.count())
    q_counts = term_counts(queries, "qid", F.col(query))
    # only terms that a query has can score, but norms need all terms of a document
    return top_k(keyword_scores(weigh(counts, vocabulary, key), weigh(q_counts, vocabulary, "qid"), key), k, ["qid"], key=key)
