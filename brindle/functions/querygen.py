"""Functions of evaluation queries: strata, authors, leakage, difficulty, templates, variants."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import ascii_tokens, draw_number, let, strip

# Query categories and their shares, length bins, genre words in order, function words.
CATEGORY_WEIGHTS = {"title_lookup": 0.20, "author": 0.15, "genre_topic": 0.30, "exploratory": 0.25, "combined": 0.10}
LENGTH_BINS = [("short", 0, 174), ("medium", 175, 887), ("long", 888, 999_999)]
HONORIFICS = ["dr. ", "dr ", "prof. ", "prof ", "sir ", "lady ", "rev. ", "rev "]
GENRES = {
    "fiction": "fiction", "romance": "romance", "mystery": "mystery", "thriller": "thriller", "history": "history",
    "biography": "biography", "science": "science", "poetry": "poetry", "children": "children", "juvenile": "children",
    "philosophy": "philosophy", "religion": "religion", "art": "art", "music": "music", "education": "education",
    "politics": "politics", "economics": "economics", "travel": "travel", "animals": "nature", "nature": "nature",
    "comic": "comics", "fantasy": "fantasy", "horror": "horror", "cooking": "cooking", "health": "health",
    "technology": "technology", "computer": "technology", "mathematics": "science", "psychology": "psychology",
    "sociology": "social_science", "law": "law", "business": "business", "sports": "sports",
}
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "it", "as", "was", "are", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "not", "no", "nor", "so",
    "if", "then", "than", "that", "this", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "they", "them",
    "their", "its", "what", "which", "who", "whom", "how", "when", "where", "why", "all", "each", "every", "both", "few", "more", "most", "other", "some",
    "such", "only", "own", "same", "about", "up", "out", "just", "also", "very", "s", "t", "d", "m", "re", "ll", "ve", "book", "books", "novel", "novels",
    "story", "stories",
]
NEAR_DUPLICATE = 0.75
RARE_SHARE = 0.001
GOLD_CAP = 50


def normalize_author(name: Column) -> Column:
    """Lower case, single spaces, each honorific taken off once, in order."""
    n = F.regexp_replace(strip(F.lower(name)), r"\s+", " ")
    def cut(prefix: str):
        return lambda x: F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1_000_000)).otherwise(x)

    return strip(reduce(lambda x, p: let(x, cut(p)), HONORIFICS, n))


def broad_genre(subjects: Column) -> Column:
    """The genre of the first word, in the map's order, that the subjects contain anywhere."""
    low = F.lower(F.array_join(subjects, " "))
    chain = None
    for word, genre in GENRES.items():
        hit = F.contains(low, F.lit(word))
        chain = F.when(hit, genre) if chain is None else chain.when(hit, genre)
    return chain.otherwise("other")


def length_bucket(description: Column) -> Column:
    n = F.length(F.coalesce(description, F.lit("")))
    return F.when(n <= LENGTH_BINS[0][2], "short").when(n <= LENGTH_BINS[1][2], "medium").otherwise("long")


def year_bucket(year: Column) -> Column:
    return F.when(year.isNull() | (year == 0), "unknown").when(year < 1900, "pre-1900").when(year < 1970, "1900-1969").when(year < 2000, "1970-1999").otherwise("2000+")


def content_tokens(c: Column) -> Column:
    return F.filter(ascii_tokens(c), lambda t: ~t.isin(*STOPWORDS))


def jaccard(query: Column, document: Column) -> Column:
    """Shared part of the distinct content words, to 4 places; 0 if there are none."""
    def of(p: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(p["q"], p["d"])), F.size(F.array_union(p["q"], p["d"]))), F.lit(0.0)), 4)

    return let(F.struct(F.array_distinct(content_tokens(query)).alias("q"), F.array_distinct(content_tokens(document)).alias("d")), of)


@F.pandas_udf(T.IntegerType())
def _longest_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common run of two lists of words: a table of runs, row by row, whose row depends on the one
    before alone. No built-in function has it."""
    def one(q: list[str], d: list[str]) -> int:
        places: dict[str, list[int]] = {}
        for j, w in enumerate(d):
            places.setdefault(w, []).append(j)
        best, last = 0, {}
        for w in q:
            now = {j: last.get(j - 1, 0) + 1 for j in places.get(w, ())}
            best = max(best, max(now.values(), default=0))
            last = now
        return best

    return pd.Series([one(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)], dtype="int32")


def longest_shared_run(query: Column, document: Column) -> Column:
    """Length of the longest run of words that both have, of any length."""
    return _longest_run(ascii_tokens(query), ascii_tokens(document))


def dedup_form(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no built-in function has it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def difficulty(category: Column, query: Column, title: Column, authors: Column, subjects: Column, year: Column, title_ratio: Column) -> Column:
    q = F.lower(query)
    full = F.exists(authors, lambda a: F.contains(q, F.lower(a)))
    last = F.exists(F.filter(authors, lambda a: strip(a) != ""), lambda a: F.contains(q, F.lower(F.element_at(F.split(strip(a), r"\s+"), -1))))
    overlap = F.size(F.filter(F.array_distinct(F.transform(subjects, F.lower)), lambda s: F.contains(q, s)))
    dated = F.contains(q, F.coalesce(year.cast("string"), F.lit("none")))
    return (
        F.when(category == "title_lookup", F.when(title_ratio > 0.95, "easy").when(title_ratio > 0.55, "medium").otherwise("hard"))
        .when(category == "author", F.when(full, "easy").when(last, "medium").otherwise("hard"))
        .when(category == "exploratory", "hard")
        .when(category == "combined", F.when((overlap >= 2) | ((overlap >= 1) & dated), "easy").when((overlap >= 1) | dated, "medium").otherwise("hard"))
        .otherwise(F.when(overlap >= 2, "easy").when(overlap >= 1, "medium").otherwise("hard"))
    )


def gold_is_complete(category: Column) -> Column:
    return category.isin("title_lookup", "author")


def pick(options: Column, *keys: Column) -> Column:
    """One of an array by a hash of keys; null of an empty one."""
    return F.get(options, draw_number(F.greatest(F.size(options), F.lit(1)), *keys))


def swap_typo(text: Column, position: Column) -> Column:
    """Two neighbouring characters swapped, the first at a 0-based position."""
    return F.concat(F.substr(text, F.lit(1), position), F.substr(text, position + 2, F.lit(1)), F.substr(text, position + 1, F.lit(1)), F.substr(text, position + 3))


def title_typo(title: Column, *keys: Column) -> Column:
    inside = F.greatest(F.length(title) - 2, F.lit(1))
    return F.when(F.length(title) < 4, title).otherwise(swap_typo(title, 1 + draw_number(inside, *keys)))


def title_part(title: Column, *keys: Column) -> Column:
    """Before a colon, else some first words, at least half of them and not all."""
    words = F.split(strip(title), r"\s+")
    n = F.size(words)
    low = F.greatest(F.lit(1), F.floor(n / 2)).cast("int")
    keep = low + draw_number(F.greatest(n - low, F.lit(1)), *keys)
    return F.when(F.contains(title, F.lit(":")), strip(F.substring_index(title, ":", 1))).when(n <= 2, title).otherwise(F.array_join(F.slice(words, F.lit(1), keep), " "))


def template_query(category: Column, title: Column, authors: Column, subjects: Column, description: Column, year: Column, seed: Column) -> Column:
    """A query from a book without a model; choices are hashes of the seed."""
    def one(tag: str, options: Column) -> Column:
        return pick(options, seed, F.lit(tag))

    variant = one("title", F.array(*map(F.lit, ["exact", "partial", "partial", "partial", "typo", "typo", "typo"])))
    by_title = F.when(variant == "exact", title).when(variant == "partial", title_part(title, seed)).otherwise(title_typo(title, seed))
    author, subject = one("who", authors), F.lower(one("what", subjects))
    last = F.element_at(F.split(strip(author), r"\s+"), -1)
    how = one("author", F.array(*map(F.lit, ["full", "full", "last", "last", "last", "phrase", "phrase", "phrase"])))
    by_author = (
        F.when(author.isNull(), F.concat(F.lit("books by unknown author about "), F.coalesce(F.get(subjects, F.lit(0)), F.lit("fiction"))))
        .when(how == "full", one("f", F.array(F.concat(F.lit("books by "), author), author)))
        .when(how == "last", one("l", F.array(F.concat(F.lit("books by "), last), F.concat(last, F.lit(" novels")), F.concat(last, F.lit(" author")))))
        .otherwise(one("p", F.array(F.concat(author, F.lit(" novels")), F.concat(F.lit("works of "), author))))
    )
    by_topic = F.coalesce(one("t", F.array(F.concat(subject, F.lit(" books")), F.concat(F.lit("books about "), subject), subject)), F.lit("general fiction books"))
    sentences = F.filter(F.transform(F.split(description, r"\."), strip), lambda s: F.length(s) > 20)
    chosen = F.when(F.size(sentences) >= 2, one("s", F.slice(sentences, F.lit(2), F.greatest(F.size(sentences), F.lit(2))))).otherwise(F.coalesce(F.get(sentences, F.lit(0)), F.substring(description, 1, 100)))
    head = F.substring(chosen, 1, 100)
    cut = F.when(F.length(chosen) > 100, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(chosen)
    by_scene = F.concat(one("e", F.array(*map(F.lit, ["book about ", "novel where ", "story involving ", "looking for "]))), F.lower(cut))
    topic = F.lower(F.coalesce(F.get(subjects, F.lit(0)), F.lit("fiction")))
    limit = F.coalesce(F.concat(F.lit("published around "), F.nullif(year, F.lit(0)).cast("string")), F.concat(F.lit("related to "), F.lower(F.get(subjects, F.lit(1)))), F.concat(F.lit("similar to "), F.get(authors, F.lit(0))), F.lit("for adults"))
    combined = one("c", F.array(F.concat_ws(" ", topic, limit), F.concat_ws(" ", limit, topic), F.concat_ws(" ", topic, F.lit("books"), limit)))
    return F.when(category == "title_lookup", by_title).when(category == "author", by_author).when(category == "genre_topic", by_topic).when(category == "exploratory", by_scene).when(category == "combined", combined).otherwise(title)


def distinctive_title(title: Column) -> Column:
    """Three words and ten characters at least, and not a long title all in capitals."""
    return (F.size(F.split(strip(title), r"\s+")) >= 3) & (F.length(title) >= 10) & ~((title == F.upper(title)) & (F.length(title) > 5))


def known_item_partial(title: Column) -> Column:
    words = F.split(strip(title), r"\s+")
    keep = F.greatest(F.lit(2), F.floor(F.size(words) * F.lit(0.6)).cast("int"))
    chain = None
    for sep in (":", " - ", " — "):
        hit, part = F.contains(title, F.lit(sep)), strip(F.substring_index(title, sep, 1))
        chain = F.when(hit, part) if chain is None else chain.when(hit, part)
    return chain.otherwise(F.array_join(F.slice(words, F.lit(1), keep), " "))


def known_item_typo(title: Column, *keys: Column) -> Column:
    """A swap inside one word of more than three letters; shorter titles stay."""
    def typo(word: Column) -> Column:
        return swap_typo(word, 1 + draw_number(F.greatest(F.length(word) - 2, F.lit(1)), *keys, F.lit("pos")))

    def of(p: Column) -> Column:
        at = pick(p["long"], *keys)
        changed = let(at, lambda i: F.array_join(F.transform(p["words"], lambda w, k: F.when(k + 1 == i, typo(w)).otherwise(w)), " "))
        return F.when((F.size(p["words"]) < 2) | (F.size(p["long"]) == 0), title).otherwise(changed)

    words = F.split(strip(title), r"\s+")
    long = F.filter(F.transform(words, lambda w, i: F.when(F.length(w) > 3, i + 1)), lambda i: i.isNotNull())
    return let(F.struct(words.alias("words"), long.alias("long")), of)
