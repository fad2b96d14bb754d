"""Agreement of raters, distributions of grades, consistency of samples: all by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MIN_NEGATIVE_RATE = 0.20


def pair_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, work_id, a, b) that both raters graded. Of repeats in b the last one (column `pos`) counts."""
    last = b.where("grade is not null").groupBy("query", "work_id").agg(F.max_by("grade", "pos").alias("b"))
    return a.where("grade is not null").select("query", "work_id", F.col("grade").alias("a")).join(last, ["query", "work_id"])


def agreement(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, kappa, alpha (nominal, two coders), raw_agreement. Under two pairs they are null.

    The contingency table has a row for each pair of labels, so all after the first aggregation is tiny.
    """
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("m"))
    marks = cells.select("m", F.col("a").alias("label"), F.lit(1).alias("of_a"), F.lit(0).alias("of_b")).unionByName(cells.select("m", F.col("b").alias("label"), F.lit(0).alias("of_a"), F.lit(1).alias("of_b")))
    per = marks.groupBy("label").agg(F.sum(F.col("m") * F.col("of_a")).alias("ra"), F.sum(F.col("m") * F.col("of_b")).alias("rb"))
    expect = per.agg(F.sum(F.col("ra") * F.col("rb")).cast("double").alias("cross"), F.sum((F.col("ra") + F.col("rb")) * (F.col("ra") + F.col("rb") - 1)).cast("double").alias("same"))
    seen = cells.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("m"))), F.lit(0)).alias("agree"))
    row = seen.crossJoin(expect)  # one row each
    n = F.col("n").cast("double")
    observed, chance = F.try_divide(F.col("agree"), n), F.try_divide(F.col("cross"), n * n)
    kappa = F.when(F.abs(chance - 1) < 1e-9, 1.0).otherwise(F.try_divide(observed - chance, 1 - chance))
    disagree = 1 - F.try_divide(F.col("same"), 2 * n * (2 * n - 1))
    alpha = F.when(disagree == 0, 1.0).otherwise(1 - F.try_divide(1 - observed, disagree))
    enough = F.col("n") >= 2
    return row.select(F.col("n").cast("long").alias("n"), F.when(enough, F.round(kappa, 4)).alias("kappa"), F.when(enough, F.round(alpha, 4)).alias("alpha"), F.when(enough, F.round(observed, 4)).alias("raw_agreement"))


def confusion(pairs: DataFrame, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    return pairs.groupBy("a").pivot("b", list(labels)).count().na.fill(0)


def grade_distribution(judgments: DataFrame) -> DataFrame:
    """One row over judgments(grade, reasoning, low_confidence): counts, percentages, rate of zeros, mean."""
    g = F.col("grade")
    total = F.count("grade")
    row = judgments.agg(
        total.alias("total_judged"), F.count("*").alias("total_pairs"), F.count_if(g.isNull()).alias("unjudged"),
        F.count_if(F.col("reasoning") == "no_consensus").alias("no_consensus"), F.count_if(F.col("low_confidence")).alias("low_confidence"),
        *(F.count_if(g == i).alias(f"n{i}") for i in range(3)), F.round(F.avg("grade"), 3).alias("mean_grade"))
    pct = [F.round(F.try_divide(F.col(f"n{i}") * 100.0, F.col("total_judged")), 1).alias(f"pct{i}") for i in range(3)]
    rate = F.coalesce(F.round(F.try_divide(F.col("n0"), F.col("total_judged").cast("double")), 3), F.lit(0.0))
    return row.select("*", *pct, rate.alias("negative_rate"), (rate < MIN_NEGATIVE_RATE).alias("too_permissive"))


def self_consistency(judgments: DataFrame) -> DataFrame:
    """One row over judgments(agreement, k_requested, n_samples_ok, low_confidence)."""
    some = F.col("k_requested") >= 2
    return judgments.agg(
        F.count_if(some).alias("total_pairs"), F.round(F.avg(F.when(some, F.col("agreement"))), 3).alias("mean_agreement"),
        F.round(F.try_divide(F.count_if(some & (F.col("agreement") >= 1)), F.nullif(F.count_if(some), F.lit(0))), 3).alias("full_agreement_rate"),
        F.count_if(some & (F.col("agreement") < 0.67)).alias("unstable_pairs"), F.count_if(some & (F.col("n_samples_ok") < F.col("k_requested"))).alias("partial_failure_pairs"),
        F.count_if(F.col("low_confidence")).alias("low_confidence_pairs"))


def contradictions(judgments: DataFrame) -> DataFrame:
    return judgments.where("contradiction").select("query", "work_id", "grade", "reasoning", F.col("contradiction_detail").alias("detail"))


def gold_pairs(queries: DataFrame) -> DataFrame:
    """(query, work_id) of queries(query, gold_work_ids)."""
    return queries.select("query", F.explode(F.array_distinct("gold_work_ids")).alias("work_id"))


def gold_agreement(gold: DataFrame, judgments: DataFrame) -> DataFrame:
    """How the judge grades gold documents: gold(query, work_id) against judgments."""
    last = judgments.groupBy("query", "work_id").agg(F.max_by("grade", "pos").alias("grade"))
    n = F.count("*")

    def rate(c: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(F.count_if(c), F.nullif(n, F.lit(0))), 3), F.lit(0.0))

    return gold.join(last, ["query", "work_id"]).agg(n.alias("gold_pairs"), rate(F.col("grade") == 2).alias("rate_grade_2"), rate(F.col("grade") > 0).alias("rate_grade_gt0"), rate(F.col("grade") == 0).alias("rate_grade_0"))


def gold_misses(gold: DataFrame, judgments: DataFrame) -> DataFrame:
    return gold.join(judgments.where("grade = 0"), ["query", "work_id"], "left_semi")


def audit_order(judgments: DataFrame) -> DataFrame:
    """What a person should look at first: no grade, low confidence, contradictions, low agreement, grade 1."""
    return judgments.orderBy(F.col("grade").isNotNull(), ~F.coalesce("low_confidence", F.lit(False)), ~F.coalesce("contradiction", F.lit(False)), F.coalesce("agreement", F.lit(1.0)), ~F.coalesce(F.col("grade") == 1, F.lit(False)), "query", "work_id")


def audit_rank(judgments: DataFrame, group: str) -> DataFrame:
    w = W.partitionBy(group).orderBy(F.col("grade").isNotNull(), ~F.col("low_confidence"), ~F.col("contradiction"), "agreement", F.coalesce(F.col("grade") != 1, F.lit(True)), "query", "work_id")
    return judgments.withColumn("audit_rank", F.row_number().over(w))
