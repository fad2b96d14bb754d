"""Judging of query-document pairs: prompts, resume, votes. Model answers arrive through a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.judging import judge, pair_key
from brindle.functions.text import draw


def prompt(query: Column, title: Column, authors: Column, description: Column, subjects: Column, seed: Column | None = None) -> Column:
    """What a judge is asked; with a seed the fields come in an order of its own for each sample."""
    tags = F.coalesce(F.nullif(F.array_join(F.slice(subjects, 1, 15), ", "), F.lit("")), F.lit("none"))
    fields = F.array(F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Authors: "), F.coalesce(authors, F.lit(""))), F.concat(F.lit("Description: "), F.coalesce(F.substring(description, 1, 500), F.lit(""))), F.concat(F.lit("Subjects: "), tags))
    if seed is not None:
        keyed = F.array_sort(F.transform(fields, lambda f: F.struct(draw(f, seed).alias("h"), f.alias("f"))))
        fields = F.transform(keyed, lambda k: k["f"])
    return F.concat(F.lit("Query: "), query, F.lit("\n\n"), F.array_join(fields, "\n"))


def to_judge(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs without a grade yet: failures are tried again, graded ones aren't."""
    return pairs.join(done.where("grade is not null").select("query", "work_id"), ["query", "work_id"], "left_anti")


def with_cache(pairs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown) by the pairs' keys."""
    keyed = pairs.withColumn("pair_key", pair_key(F.col("query"), F.col("work_id")))
    return keyed.join(cache, "pair_key"), keyed.join(cache.select("pair_key"), "pair_key", "left_anti")


def aggregate(samples: DataFrame, escalation: int = 2) -> DataFrame:
    """Judgments from samples(query, work_id, title, samples, reasons, extra, extra_reasons, k)."""
    j = judge(F.col("samples"), F.col("reasons"), F.col("extra"), F.col("extra_reasons"), F.col("k"), escalation)
    return samples.select("query", "work_id", "title", j.alias("j")).select("query", "work_id", "title", "j.*")


def usage_cost(usage: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Tokens and cost, prices being for a million tokens."""
    return usage.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round((F.sum("input_tokens") * input_price + F.sum("output_tokens") * output_price) / 1e6, 6).alias("cost"))
