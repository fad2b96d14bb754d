"""Deterministic top-k, fusion of ranked lists, mode overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Digits of a score that decide an order: beyond them engines differ by the order of summation.
SCORE_DIGITS = 10
#: Rows of a side that may be broadcast, and bytes by the optimizer's own estimate.
MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint behind a check of the size: rows where they are known, else they are counted if the plan
    multiplies rows (the optimizer's estimate doesn't), else that estimate. A larger side is left to the
    optimizer, which shuffles it."""
    if rows is None and "Generate" in df._jdf.queryExecution().optimizedPlan().toString():
        rows = df.limit(MAX_BROADCAST_ROWS + 1).count()
    if rows is not None:
        return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def tie_order(score: str = "score", key: str = "key") -> list[Column]:
    return [F.round(F.col(score), SCORE_DIGITS).desc(), F.col(key).asc()]


def top_k(df: DataFrame, k: int, group: list[str], score: str = "score", key: str = "key", rank: str = "rank") -> DataFrame:
    """The k best of each group, by score and then by key, so equal scores always fall the same way.
    Spark cuts each task's groups to k before the shuffle."""
    w = W.partitionBy(*group).orderBy(*tie_order(score, key))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def reciprocal_rank_fusion(arms: list[DataFrame], group: list[str], key: str = "key", k: int = 2, rank_base: int = 0, rank: str = "rank") -> DataFrame:
    """Fuse ranked arms (rank from 1): the sum of 1 / (k + rank), the rank counted from `rank_base`. What
    is in one arm alone stays. The served constants are k=2 from 0; k=60 from 1 are the documented ones."""
    parts = [a.select(*group, key, (1.0 / (F.lit(k) + F.col(rank) - 1 + rank_base)).alias("part")) for a in arms]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*group, key).agg(F.sum("part").alias("score"))


def overlap(hits: DataFrame, group: str = "qid", key: str = "key", mode: str = "mode") -> DataFrame:
    """For each query and pair of modes: shared hits, and their share of the longer list in percent."""
    sets = hits.groupBy(group, mode).agg(F.collect_set(key).alias("keys"))  # at most k hits each
    a, b = sets.select(group, F.col(mode).alias("mode_a"), F.col("keys").alias("ka")), sets.select(group, F.col(mode).alias("mode_b"), F.col("keys").alias("kb"))
    both = a.join(b, group).where("mode_a < mode_b").withColumn("shared", F.size(F.array_intersect("ka", "kb")))
    return both.select(group, "mode_a", "mode_b", "shared", F.round(100 * F.col("shared") / F.greatest(F.size("ka"), F.size("kb")), 0).cast("int").alias("percent"))


def rerank_depth(top: int, multiplier: float = 2.5) -> int:
    return max(top, int(top * multiplier))


def rerank(candidates: DataFrame, score: Column, top: int, group: list[str], original: str = "rank") -> DataFrame:
    """Order candidates by a score, equal ones as retrieved: rerank_score, original_rank, rank_change."""
    scored = candidates.withColumn("rerank_score", score.cast(T.DoubleType()))
    w = W.partitionBy(*group).orderBy(F.col("rerank_score").desc(), F.col(original).asc())
    out = scored.withColumn("original_rank", F.col(original)).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top)
    return out.drop(original).withColumnRenamed("new_rank", "rank").withColumn("rerank_score", F.round("rerank_score", 4)).withColumn("rank_change", F.col("original_rank") - F.col("rank"))
