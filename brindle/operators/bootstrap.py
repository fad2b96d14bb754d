"""Bootstrap intervals per group, bit for bit reproducible: grouped pandas over per-query values.

A group holds a value for each evaluation query, hundreds to thousands, which bounds each task."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

REPLICATES = 1000
# The seeds of the mode, pair and category intervals.
MODE_SEED, PAIR_SEED, CATEGORY_SEED = 42, 1000, 2000
LOW_N = 30


def percentile_ci(values: np.ndarray, rng: np.random.Generator, replicates: int = REPLICATES) -> np.ndarray:
    n = len(values)
    return np.percentile([values[rng.integers(0, n, n)].mean() for _ in range(replicates)], [2.5, 97.5])


def opposite_share(deltas: np.ndarray, boots: np.ndarray) -> float:
    """Part of the replicates on the other side of zero than the mean."""
    mean = deltas.mean()
    if mean > 0:
        return float((boots <= 0).mean())
    return float((boots >= 0).mean()) if mean < 0 else 0.5


def mode_intervals(per_query: DataFrame, modes: list[str], replicates: int = REPLICATES) -> DataFrame:
    """(mode, metric, mean, low, high): a generator for each mode, drawn on by mrr, ndcg and recall in turn."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mode = pdf["mode"].iloc[0]
        pdf = pdf.sort_values("query")
        rng = np.random.default_rng(MODE_SEED + modes.index(mode))
        rows = []
        for metric in ("mrr", "ndcg", "recall"):
            values = pdf[metric].to_numpy()
            low, high = percentile_ci(values, rng, replicates)
            rows.append((mode, metric, round(float(values.mean()), 4), round(float(low), 4), round(float(high), 4)))
        return pd.DataFrame(rows, columns=["mode", "metric", "mean", "low", "high"])

    return per_query.where(per_query["mode"].isin(*modes)).groupBy("mode").applyInPandas(run, "mode string, metric string, mean double, low double, high double")


PAIRED = "name string, metric string, n_queries long, delta double, low double, high double, p_opposite double, significant boolean, low_n boolean"


def _paired(name: str, metric: str, deltas: np.ndarray, boots: np.ndarray) -> tuple:
    low, high = np.percentile(boots, [2.5, 97.5])
    return name, metric, len(deltas), round(float(deltas.mean()), 4), round(float(low), 4), round(float(high), 4), round(opposite_share(deltas, boots), 4), bool(low > 0 or high < 0), len(deltas) < LOW_N


def paired_intervals(per_query: DataFrame, pairs: list[tuple[str, str]], replicates: int = REPLICATES) -> DataFrame:
    """Differences of ndcg and mrr between modes over the same queries, both on one matrix of draws."""
    def compare(i: int, mode: str, base: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            wide = pdf.pivot(index="query", columns="mode", values=["ndcg", "mrr"]).dropna().sort_index()
            n = len(wide)
            draws = np.random.default_rng(PAIR_SEED + i).integers(0, n, (replicates, n))
            rows = []
            for metric in ("ndcg", "mrr"):
                deltas = (wide[metric][mode] - wide[metric][base]).to_numpy()
                rows.append(_paired(f"{mode} - {base}", metric, deltas, np.array([deltas[d].mean() for d in draws])))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRED.split(", ")])

        return run

    out = None
    for i, (mode, base) in enumerate(pairs):
        some = per_query.where(per_query["mode"].isin(mode, base)).withColumn("pair", per_query["mode"].isNotNull())
        part = some.select("pair", "query", "mode", "ndcg", "mrr").groupBy("pair").applyInPandas(compare(i, mode, base), PAIRED)
        out = part if out is None else out.unionByName(part)
    return out


def category_intervals(per_query: DataFrame, mode: str, base: str, categories: list[str], replicates: int = REPLICATES) -> DataFrame:
    """The same for ndcg in each category of queries (per_query has a column category)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        category = pdf["category"].iloc[0]
        wide = pdf.pivot(index="query", columns="mode", values="ndcg").dropna().sort_index()
        deltas, n = (wide[mode] - wide[base]).to_numpy(), len(wide)
        rng = np.random.default_rng(CATEGORY_SEED + categories.index(category))
        boots = np.array([deltas[rng.integers(0, n, n)].mean() for _ in range(replicates)])
        return pd.DataFrame([_paired(category, "ndcg", deltas, boots)], columns=[c.split()[0] for c in PAIRED.split(", ")])

    some = per_query.where(per_query["mode"].isin(mode, base))
    return some.select("category", "query", "mode", "ndcg").groupBy("category").applyInPandas(run, PAIRED)


def index_percentile_intervals(per_query: DataFrame, metric: str, seed: int = 42, replicates: int = REPLICATES) -> DataFrame:
    """(mode, low, high) by sorted means at fixed indexes, drawn with Python's generator."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("query")[metric].tolist()
        rng, n = random.Random(seed), len(values)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(replicates))
        return pd.DataFrame([(pdf["mode"].iloc[0], round(means[int(0.025 * replicates)], 4), round(means[int(0.975 * replicates)], 4))], columns=["mode", "low", "high"])

    return per_query.select("mode", "query", metric).groupBy("mode").applyInPandas(run, "mode string, low double, high double")
