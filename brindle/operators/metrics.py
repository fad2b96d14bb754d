"""Retrieval metrics over long tables: rankings(mode, query, rank, work_id), grades(query, work_id, grade)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.operators.ranking import small_side


def judged(rankings: DataFrame, grades: DataFrame) -> DataFrame:
    """Each ranked document with its grade; an unjudged one counts 0. Grades of other documents go before anything is
    shuffled, where the rankings are few."""
    known = grades.where("grade is not null").select("query", "work_id", "grade")
    known = known.join(small_side(rankings.select("query", "work_id")), ["query", "work_id"], "left_semi")
    return rankings.join(known, ["query", "work_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def ideal_dcg(grades: DataFrame, k: int = 10) -> DataFrame:
    """(query, idcg, relevant_total): the best order of all judged documents, and how many are relevant. Documents
    of one grade stand together there, so their number is enough; it is combined on the map side."""
    counts = grades.where("grade is not null").groupBy("query", "grade").agg(F.count("*").alias("n"))
    w = W.partitionBy("query").orderBy(F.col("grade").desc())
    placed = counts.withColumn("last", F.sum("n").over(w)).withColumn("first", F.col("last") - F.col("n") + 1)
    places = F.when((F.col("grade") > 0) & (F.col("first") <= k), F.sequence(F.col("first"), F.least(F.col("last"), F.lit(k).cast("long")))).otherwise(F.array().cast("array<long>"))
    gain = F.aggregate(places, F.lit(0.0), lambda total, place: total + F.col("grade") / F.log2(place + 1))
    return placed.groupBy("query").agg(F.sum(gain).alias("idcg"), F.coalesce(F.sum(F.when(F.col("grade") > 0, F.col("n"))), F.lit(0)).alias("relevant_total"))


def query_metrics(rankings: DataFrame, grades: DataFrame, k: int = 10, at_least: int = 1) -> DataFrame:
    """A row for each mode and query: mrr, ndcg, recall, precision, relevant_found, relevant_total.
    Queries without judgments give 0; `at_least` is the grade that counts as relevant."""
    top = judged(rankings.where(F.col("rank") <= k), grades)
    hit = F.col("grade") >= at_least
    gain = F.when(F.col("grade") > 0, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = top.groupBy("mode", "query").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"), F.count_if(hit).alias("relevant_found"))
    ideal = ideal_dcg(grades, k)
    if at_least != 1:
        strict = grades.groupBy("query").agg(F.count_if(F.col("grade") >= at_least).alias("strict"))
        ideal = ideal.join(strict, "query").withColumn("relevant_total", F.col("strict")).drop("strict")
    out = per.join(ideal, "query", "left")
    total = F.coalesce("relevant_total", F.lit(0))
    return out.select(
        "mode", "query",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide("dcg", F.nullif("idcg", F.lit(0.0))), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.col("relevant_found"), F.nullif(total, F.lit(0))), F.lit(0.0)).alias("recall"),
        (F.col("relevant_found") / F.lit(k) if k else F.lit(0.0)).alias("precision"),
        F.col("relevant_found").cast("long").alias("relevant_found"), total.cast("long").alias("relevant_total"))


def with_relevant(grades: DataFrame) -> DataFrame:
    """Queries with a relevant document."""
    return grades.groupBy("query").agg(F.max("grade").alias("best")).where("best > 0").select("query")


def in_all_modes(rankings: DataFrame, modes: int) -> DataFrame:
    """Queries that every mode answered: comparisons are paired."""
    return rankings.groupBy("query").agg(F.countDistinct("mode").alias("n")).where(F.col("n") == modes).select("query")


def mean_metrics(per_query: DataFrame, *by: str) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(m), 4).alias(m) for m in ("mrr", "ndcg", "recall", "precision")))


def recall_ceiling(grades: DataFrame, k: int = 10) -> DataFrame:
    """Mean of the recall that a perfect ranking of k can reach."""
    n = grades.groupBy("query").agg(F.count_if(F.col("grade") > 0).alias("n")).where("n > 0")
    return n.agg(F.round(F.avg(F.least(F.lit(1.0), F.lit(float(k)) / F.col("n"))), 6).alias("recall_ceiling"))


def random_mrr(pool: Column, relevant: Column, k: int = 10) -> Column:
    """Expected reciprocal rank of a random order, in closed form: the sum over places i of 1/i times the
    chance that the first relevant one stands there."""
    total = F.lit(0.0)
    none_before = F.lit(1.0)
    for i in range(1, k + 1):
        left = pool - (i - 1)
        hit = F.when(left > 0, F.least(F.lit(1.0), relevant / F.greatest(left, F.lit(1)))).otherwise(0.0)
        total = total + none_before * hit / F.lit(float(i))
        none_before = none_before * (F.lit(1.0) - hit)
    return F.when((pool > 0) & (relevant > 0), total).otherwise(0.0)


def oracle_order(candidates: DataFrame, depth: int = 25, group: tuple[str, ...] = ("query",)) -> DataFrame:
    """The best order of retrieved candidates by their grades, equal ones as retrieved."""
    w = W.partitionBy(*group).orderBy(F.col("grade").desc(), "rank")
    return candidates.where(F.col("rank") <= depth).withColumn("rank", F.row_number().over(w))


def known_item_accuracy(items: DataFrame, rankings: DataFrame, *by: str) -> DataFrame:
    """Items(query, work_id, ...) against rankings(mode, query, rank, work_id): accuracy at 1 and 5, MRR. An
    item that a mode missed, or that failed, counts as a miss."""
    modes = rankings.select("mode").distinct()
    found = rankings.groupBy("mode", "query", "work_id").agg(F.min("rank").alias("rank"))
    rows = items.crossJoin(small_side(modes)).join(found, ["mode", "query", "work_id"], "left")
    return rows.groupBy("mode", *by).agg(
        F.count("*").alias("total"), F.count_if(F.col("rank") == 1).alias("hits_at_1"), F.count_if(F.col("rank") <= 5).alias("hits_at_5"),
        F.round(F.count_if(F.col("rank") == 1) / F.count("*"), 4).alias("accuracy_at_1"), F.round(F.count_if(F.col("rank") <= 5) / F.count("*"), 4).alias("accuracy_at_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


def gate(current: DataFrame, baseline: DataFrame, gated: list[str], max_drop: float = 5.0) -> DataFrame:
    """Per mode: delta in points against the baseline and whether it holds. Modes that aren't gated, or
    have no baseline, pass."""
    joined = current.select("mode", "accuracy_at_1").join(baseline.select("mode", F.col("accuracy_at_1").alias("base")), "mode", "left")
    delta = F.round((F.col("accuracy_at_1") - F.col("base")) * 100, 4)
    return joined.select("mode", "accuracy_at_1", "base", delta.alias("delta_pp"), F.col("mode").isin(*gated).alias("gated"), (~F.col("mode").isin(*gated) | F.coalesce(delta >= -max_drop, F.lit(True))).alias("passed"))


def gate_problems(baseline_gated: list[str], gated: list[str], evaluated: list[str], fast: bool, update: bool) -> list[str]:
    """Why a gate run must be refused: modes dropped from the gate or not evaluated, a baseline from a
    fast run."""
    out = [f"mode {m} is in the baseline's gate but not in this one" for m in baseline_gated if m not in gated]
    out += [f"gated mode {m} isn't evaluated" for m in gated if m not in evaluated]
    return out + (["a fast run can't update the baseline"] if fast and update else [])


def leading_mode(mode: str) -> tuple[str, bool]:
    return (mode.removesuffix("+rerank"), True) if mode.endswith("+rerank") else (mode, False)


def missing_queries(rankings: DataFrame, queries: DataFrame) -> DataFrame:
    """(mode, query) that a mode has no result for: left out of every paired comparison."""
    asked = queries.select("query").distinct().crossJoin(small_side(rankings.select("mode").distinct()))
    return asked.join(rankings.select("mode", "query").distinct(), ["mode", "query"], "left_anti").select("mode", "query")


def with_category(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's category, "unknown" where it has none."""
    known = queries.groupBy("query").agg(F.min("category").alias("category"))
    return per_query.drop("category").join(known, "query", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def random_mrr_trials(pools: DataFrame, trials: int = 2000, seed: int = 42, k: int = 10) -> DataFrame:
    """(query, random_mrr) of pools(query, pool, relevant) by shuffles: the mean of the first relevant place's
    reciprocal over seeded random orders, 0 beyond k. `random_mrr` is its expectation in closed form.

    Only the first k places of an order count, so no more of it are drawn: the cost of a trial doesn't grow with the
    pool."""
    def run(parts):
        for pdf in parts:
            out = []
            for query, pool, relevant in zip(pdf["query"], pdf["pool"], pdf["relevant"], strict=True):
                rng = random.Random(f"{seed}|{query}")
                total = 0.0
                for _ in range(trials if pool and relevant else 0):
                    order = rng.sample(range(pool), min(k, pool))  # documents below `relevant` are the relevant ones
                    total += next((1.0 / place for place, document in enumerate(order, 1) if document < relevant), 0.0)
                out.append(round(total / trials, 6))
            yield pdf[["query"]].assign(random_mrr=out)

    return pools.select("query", "pool", "relevant").mapInPandas(run, f"query {pools.schema['query'].dataType.simpleString()}, random_mrr double")
