"""Query intent and year filters as one CASE chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import strip

# The patterns and words that tell intents apart, in order of trial.
ISBN = r"(?:978|979)[\-\s]?\d[\-\s]?\d{2}[\-\s]?\d{6}[\-\s]?\d"
SIMILAR = [
    r"(?:books?|novels?|stories?)\s+(?:like|similar\s+to|resembling)\s+(.+)",
    r"(?:similar|like)\s+(.+)",
    r"(?:if\s+(?:i|you)\s+liked?)\s+(.+)",
    r"(?:recommend.*(?:based on|like))\s+(.+)",
]
AUTHOR = [
    r"(?:books?\s+)?by\s+([A-Z][\w.]+(?:\s+[A-Z][\w.]+)+)",
    r"([A-Z][\w.]+(?:\s+[A-Z][\w.]+)+)\s+(?:books?|novels?|works?|writing)",
    r"(?:author|written by)\s+(.+)",
]
YEAR = r"(\d{4})"
DECADE = r"(\d{4})s"
TEMPORAL = ["published", "after", "before", "since", "until"]
CONCEPT = ["about", "exploring", "theme of", "meaning of", "stories of", "books about", "novels about", "dealing with", "understanding"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def year_filters(query: Column) -> tuple[Column, Column]:
    """(year_min, year_max): only with an explicit temporal word; a decade before a year."""
    low = F.lower(query)
    decade = F.nullif(F.regexp_extract(low, DECADE, 1), F.lit("")).cast("int")
    year = F.nullif(F.regexp_extract(low, YEAR, 1), F.lit("")).cast("int")
    temporal, since, until = _any(low, TEMPORAL), _any(low, ["after", "since"]), _any(low, ["before", "until"])
    lower = F.when(temporal & decade.isNotNull(), decade).when(temporal & year.isNotNull() & (since | ~until), year)
    upper = F.when(temporal & decade.isNotNull(), decade + 9).when(temporal & year.isNotNull() & ~since, year)
    return lower, upper


def classify(query: Column) -> Column:
    """A struct: intent, search_mode, boost_keyword, year_min, year_max, extracted_title, confidence."""
    low = strip(F.lower(query))
    none, one = F.lit(None), F.lit(1.0)

    def kind(intent: str, mode: str, confidence: float, boost: float = 1.0, lower: Column = none, upper: Column = none, title: Column = none) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(mode).alias("search_mode"), (one * boost).alias("boost_keyword"), lower.cast("int").alias("year_min"), upper.cast("int").alias("year_max"), title.cast("string").alias("extracted_title"), F.lit(confidence).alias("confidence"))

    lower, upper = year_filters(query)
    filtered = lower.isNotNull() | upper.isNotNull()
    chain = F.when(query.rlike(ISBN), kind("keyword", "keyword", 0.95))
    for p in SIMILAR:
        title = F.regexp_replace(strip(F.regexp_extract(low, p, 1)), "^[\"']+|[\"']+$", "")
        chain = chain.when(low.rlike(p), kind("similar_to", "vector", 0.9, title=title))
    for p in AUTHOR:
        chain = chain.when(query.rlike(p), kind("author", "hybrid", 0.8, 2.0))
    chain = chain.when(_any(low, CONCEPT) & ~filtered, kind("semantic", "hybrid", 0.7, 0.5))
    chain = chain.when(filtered, kind("filtered", "hybrid", 0.7, lower=lower, upper=upper))
    return chain.otherwise(kind("semantic", "hybrid", 0.5))
