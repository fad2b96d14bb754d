"""Language by profiles of character trigrams: fitted on labelled texts, applied in batches."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.ranking import top_k

#: Trigrams of each language that its profile keeps, the most frequent ones: the profiles are sent to every task.
PROFILE_SIZE = 2000
_OTHER = re.compile(r"[\W\d_]+")


def trigrams(text: str | None) -> Counter:
    """All runs of three characters of a lower-case text's words, with single spaces between and around them."""
    plain = f" {_OTHER.sub(' ', (text or '').lower()).strip()} "
    return Counter(map("".join, zip(plain, plain[1:], plain[2:], strict=False))) if len(plain) > 2 else Counter()


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> dict[str, dict[str, float]]:
    """Log probabilities of each language's commonest trigrams, over all texts of docs. Each task counts its own
    before the shuffle, and `size` rows of a language are collected."""
    def count(parts):
        found: dict[str, Counter] = {}
        for pdf in parts:
            for name, t in zip(pdf["lang"], pdf["text"], strict=True):
                found.setdefault(name, Counter()).update(trigrams(t))
        rows = [(name, gram, n) for name, grams in found.items() for gram, n in grams.items()]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    best = top_k(counts.withColumn("score", F.col("n").cast("double")), size, ["lang"], key="gram").collect()
    out: dict[str, dict[str, float]] = {name: {"": math.log(1 / (n + size))} for name, n in total.items()}  # "": any other trigram
    for r in best:
        out[r["lang"]][r["gram"]] = math.log((r["n"] + 1) / (total[r["lang"]] + size))
    return out


def detect(profiles: dict[str, dict[str, float]]):
    """A Column function: the most likely language of a whole text, null for one without letters or profiles."""
    names = sorted(profiles)

    @F.pandas_udf(T.StringType())
    def udf(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            counts = trigrams(text)
            if not counts or not names:
                return None
            return max(names, key=lambda name: sum(n * profiles[name].get(g, profiles[name][""]) for g, n in counts.items()))

        return pd.Series([one(t) for t in texts], dtype=object)

    return udf
