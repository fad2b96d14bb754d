"""The dense arm: unit vectors, truncation, exact cosine search in blocks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import let
from brindle.operators.ranking import SCORE_DIGITS, top_k

WORD = re.compile(r"[^\W_]+")
#: Query vectors in a block, and rows of an index that are scored against a block at once.
QUERY_BLOCK = 1024
SCORE_ROWS = 2048
#: Bytes of query vectors that may be sent to every task; more are joined with the index block by block.
MAX_QUERY_BYTES = 64 << 20


def normalize(v: Column) -> Column:
    """To unit length in double precision; a zero vector stays as it is. Vector and norm are bound once,
    so the cost is linear in the length."""
    def scale(d: Column) -> Column:
        norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d))

    return let(v.cast("array<double>"), scale)


def truncate(v: Column, dim: int) -> Column:
    """The first components, back to unit length (nested representations)."""
    return normalize(F.slice(v, 1, dim))


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def word_hash_model(dim: int):
    """A list of texts to signed sums of hashed words: linear in the words and the dimension."""
    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            marks = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in WORD.findall(text.lower())], np.int64)
            if len(marks):
                row += np.bincount((marks >> 1) % dim, np.where(marks & 1, -1.0, 1.0), dim)
        return out

    return model


def hashed_embedding(text: Column, dim: int = 256) -> Column:
    """An offline stand-in for an embedding model: signed hashed words, unit length."""
    return embed_udf(word_hash_model(dim), dim)(text)


def _packed(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Blocks of rows (keys, vectors as doubles in a row, length), so that a block is one row of a join."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows or max(1, b.num_rows)):
                some = b.slice(at, rows or b.num_rows)
                flat = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ends = pa.array([0, some.num_rows], pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(ends, some.column(0)), pa.array([flat.tobytes()], pa.binary()), pa.array([len(flat) // some.num_rows], pa.int32())], names=["keys", "flat", "dim"])

    return df.mapInArrow(run, f"keys array<{kind}>, flat binary, dim int")


def best_pairs(score: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, equal scores by `order` of the columns."""
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
        i, j = np.nonzero(score >= least[:, None])
    else:
        i, j = np.divmod(np.arange(score.size), max(1, score.shape[1]))
    place = np.lexsort((order[j], -score[i, j], i))
    i, j = i[place], j[place]
    first = np.searchsorted(i, np.arange(score.shape[0]))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep]


def vector_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "key", vector: str = "vector") -> DataFrame:
    """(qid, key, score, rank) of `queries(qid, vector)` against all rows of `docs(key, vector)`.

    Blocks of queries meet blocks of rows; a pair of blocks is a matrix product that passes on its own k
    best for each query, and the global cut follows. Nothing is collected. The blocks of queries are
    broadcast behind a check of their bytes, else the blocks are joined by a shuffle. Filters on `docs`
    come before. Null vectors are left out.
    """
    q = queries.select("qid", F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = _packed(q.repartition(max(1, -(-n // QUERY_BLOCK))), "qid", QUERY_BLOCK).select(F.col("keys").alias("qids"), F.col("flat").alias("asked"), F.col("dim").alias("q_dim"))
    if n * dim * 8 <= MAX_QUERY_BYTES:
        blocks = F.broadcast(blocks)
    rows = _packed(docs.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null"), key)
    key_type, qid_type = docs.schema[key].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                keys, qids = b.column(0).slice(r, 1).flatten(), b.column(3).slice(r, 1).flatten()
                x = np.frombuffer(b.column(1)[r].as_py()).reshape(-1, b.column(2)[r].as_py())
                asked = np.frombuffer(b.column(4)[r].as_py()).reshape(-1, b.column(5)[r].as_py())
                order = np.empty(len(keys), np.int64)
                order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                for at in range(0, len(x), SCORE_ROWS):
                    score = np.round(asked @ x[at : at + SCORE_ROWS].T, SCORE_DIGITS)
                    i, j = best_pairs(score, order[at : at + SCORE_ROWS], k)
                    yield pa.record_batch([qids.take(pa.array(i)), keys.take(pa.array(j + at)), pa.array(score[i, j])], names=["qid", key, "score"])

    pairs = rows.crossJoin(blocks)  # blocks of a stated query set against all blocks of rows
    return top_k(pairs.mapInArrow(run, f"qid {qid_type}, `{key}` {key_type}, score double"), k, ["qid"], key=key)


def embed_udf(model, dim: int):
    """A vector column from any model that maps a list of texts to rows of numbers: cut and normalised."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = np.asarray(model(texts.fillna("").tolist()), np.float64)[:, :dim]
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(norms > 0, norms, 1)))

    return embed
