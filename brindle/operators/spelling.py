"""Spelling correction by symmetric deletes: an equi-join on deletion forms, verified exactly."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from brindle.functions.text import alphabetic_words, let
from brindle.operators.ranking import small_side

MAX_DISTANCE = 2
CORPUS_FREQUENCY = 1000


def _deletes(words: Column) -> Column:
    """All forms of words with one character less, and the words."""
    def shorter(ws: Column) -> Column:
        return F.array_distinct(F.concat(ws, F.flatten(F.transform(ws, lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))))))

    return let(words, shorter)


def deletion_forms(word: Column, distance: int = MAX_DISTANCE) -> Column:
    forms = F.array(word)
    for _ in range(distance):
        forms = _deletes(forms)
    return forms


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Optimal string alignment: edits, and swaps of neighbours that aren't edited again. No built-in
    function counts swaps."""
    def one(x: str, y: str) -> int:
        before, last = [], list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, before[j - 2] + 1)
                row.append(best)
            before, last = last, row
        return last[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def byte_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Damerau-Levenshtein distance of the UTF-8 bytes, as DuckDB's damerau_levenshtein counts it: swapped bytes may
    be edited again, and a character of two bytes is two insertions."""
    def one(x: bytes, y: bytes) -> int:
        far = len(x) + len(y)
        rows = [[far] * (len(y) + 2), [far, *range(len(y) + 1)]]
        seen: dict[int, int] = {}
        for i, c in enumerate(x, 1):
            row, at = [far, i], 0
            for j, d in enumerate(y, 1):
                k = seen.get(d, 0)
                row.append(min(rows[i][j] + (c != d), rows[i][j + 1] + 1, row[j] + 1, rows[k][at] + (i - k - 1) + 1 + (j - at - 1)))
                if c == d:
                    at = j
            rows.append(row)
            seen[c] = i
        return rows[-1][-1]

    return pd.Series([one(x.encode(), y.encode()) for x, y in zip(a, b, strict=True)], dtype="int32")


def build_dictionary(books: DataFrame, frequency: int = CORPUS_FREQUENCY) -> DataFrame:
    """(term, freq): words of titles, authors and subjects of indexed books."""
    words = F.concat(alphabetic_words(F.col("title")), F.flatten(F.transform("authors", lambda a: alphabetic_words(a))), F.flatten(F.transform("subjects", lambda s: alphabetic_words(s, ",.;:()"))))
    return books.where("description is not null and description <> ''").select(F.explode(words).alias("term")).distinct().select("term", F.lit(frequency).cast("long").alias("freq"))


def merge_dictionaries(*parts: DataFrame) -> DataFrame:
    """Counts of a term that several dictionaries have are added."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term").agg(F.sum("freq").alias("freq"))


def closest_terms(words: DataFrame, dictionary: DataFrame, distance: int = MAX_DISTANCE, measure: Callable[[str, str], Column] = osa_distance) -> DataFrame:
    """(word, term, distance): the closest term by `measure`, the most frequent of equally close ones, then the first
    by name. The few distinct words are broadcast where they are few; the dictionary is read once."""
    asked = words.select("word").distinct().select("word", F.explode(deletion_forms(F.col("word"), distance)).alias("form"))
    known = dictionary.select("term", "freq", F.explode(deletion_forms(F.col("term"), distance)).alias("form"))
    pairs = known.join(small_side(asked), "form").select("word", "term", "freq").distinct()
    close = pairs.withColumn("distance", measure("word", "term")).where(F.col("distance") <= distance)
    w = W.partitionBy("word").orderBy("distance", F.col("freq").desc(), "term")
    return close.withColumn("n", F.row_number().over(w)).where("n = 1").select("word", "term", "distance")


def asked_words(queries: DataFrame) -> DataFrame:
    """(qid, pos, raw, word, asked) of the words of queries(qid, query): words of up to two characters and numbers
    aren't asked for."""
    split = queries.select("qid", F.posexplode(F.split(F.trim(F.regexp_replace("query", r"\s+", " ")), " ")).alias("pos", "raw"))
    return split.withColumn("word", F.lower("raw")).withColumn("asked", (F.length("raw") > 2) & ~F.col("raw").rlike(r"^\d+$"))


def correct(queries: DataFrame, dictionary: DataFrame, distance: int = MAX_DISTANCE, measure: Callable[[str, str], Column] = osa_distance) -> DataFrame:
    """Queries(qid, query) with corrected and was_corrected. Words of up to two characters and numbers
    stay, and so does a known word, in its own case."""
    split = asked_words(queries)
    found = closest_terms(split.where("asked"), dictionary, distance, measure)
    joined = split.join(found, "word", "left").withColumn("new", F.when(F.col("asked") & (F.col("distance") > 0), F.col("term")))
    done = joined.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "raw").alias("w")))).alias("ws"), F.bool_or(F.col("new").isNotNull()).alias("was_corrected"))
    out = queries.join(done, "qid", "left")
    return out.select("qid", "query", F.coalesce(F.array_join(F.transform("ws", lambda s: s["w"]), " "), F.lit("")).alias("corrected"), F.coalesce("was_corrected", F.lit(False)).alias("was_corrected"))


def suggest(queries: DataFrame, dictionary: DataFrame, n: int = 3, distance: int = MAX_DISTANCE) -> DataFrame:
    """(qid, place, suggestion): up to n corrected forms of whole queries that differ from the query, the best
    first: the words' best terms, then words split or joined by mistake (`compounds`)."""
    fixed = correct(queries, dictionary, distance).select("qid", F.lower("query").alias("low"), F.lit(0).alias("kind"), F.lower("corrected").alias("suggestion"))
    joined = compounds(queries, dictionary).select("qid", F.lower("query").alias("low"), F.lit(1).alias("kind"), "suggestion")
    some = fixed.unionByName(joined).where("suggestion <> low").groupBy("qid", "suggestion").agg(F.min("kind").alias("kind"))
    w = W.partitionBy("qid").orderBy("kind", "suggestion")
    return some.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("qid", "place", "suggestion")


def compounds(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(qid, query, suggestion): queries with an unknown word split into two known ones, or with two words in a
    row, one of them unknown, joined to a known one; one change at a time."""
    words = queries.select("qid", "query", F.split(F.trim(F.lower(F.regexp_replace("query", r"\s+", " "))), " ").alias("ws"))
    at = words.select("qid", "query", "ws", F.posexplode("ws").alias("pos", "word"))
    known = dictionary.select("term").distinct()
    unknown = at.join(known, at["word"] == known["term"], "left_anti").where("length(word) > 2")
    cuts = unknown.select("qid", "query", "ws", "pos", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut")).select("qid", "query", "ws", "pos", F.substr("word", F.lit(1), F.col("cut")).alias("a"), F.substr("word", F.col("cut") + 1).alias("b"))
    split = cuts.join(known.select(F.col("term").alias("a")), "a").join(known.select(F.col("term").alias("b")), "b")
    parts = split.select("qid", "query", F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("pos")), F.array("a", "b"), F.slice("ws", F.col("pos") + 2, F.size("ws"))), " ").alias("suggestion"))
    pairs = unknown.select("qid", "query", "ws", F.explode(F.array(F.col("pos") - 1, F.col("pos"))).alias("pos")).where("pos >= 0 and pos + 1 < size(ws)").distinct()
    both = pairs.withColumn("term", F.concat(F.get("ws", F.col("pos")), F.get("ws", F.col("pos") + 1))).join(known, "term")
    whole = both.select("qid", "query", F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("pos")), F.array("term"), F.slice("ws", F.col("pos") + 3, F.size("ws"))), " ").alias("suggestion"))
    return parts.unionByName(whole).distinct()
