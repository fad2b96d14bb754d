"""Corpus building: usable rows, language, ambiguous texts, records, unique ids, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions.text import MAX_AUTHORS, MAX_SUBJECTS, clean_description, draw, english_by_stopwords, repair_text, split_list, strip, usable, work_id

# The tier of a book without one, and the name of the raw data.
UNKNOWN_TIER = 99
SOURCE_NAME = "goodreads_100k"


def usable_rows(raw: DataFrame) -> DataFrame:
    return raw.where(usable(F.col("title"), F.col("author"), F.col("desc")))


def english_rows(raw: DataFrame, text: str = "desc", lang: str | None = None, detect=None) -> DataFrame:
    """By a language column where there is one, else by a detector (a Column function of the text to a language,
    as `language.detect`), else by function words."""
    if lang:
        return raw.where(F.col(lang) == "en")
    return raw.where(detect(F.col(text)) == "en") if detect else raw.where(english_by_stopwords(F.col(text)))


def drop_ambiguous(rows: DataFrame, text: str = "desc", author: str = "author") -> DataFrame:
    """Without texts that several authors share. Texts are compared by a digest, so that long ones
    aren't shuffled twice; only the ambiguous digests are joined."""
    keyed = rows.withColumn("__digest", F.sha2(strip(F.col(text)), 256))
    who = F.lower(strip(F.col(author)))
    shared = keyed.groupBy("__digest").agg(F.min(who).alias("a"), F.max(who).alias("z")).where("a < z")
    return keyed.join(shared, "__digest", "left_anti").drop("__digest")


def records(raw: DataFrame, repair=repair_text) -> DataFrame:
    """Raw rows (row_idx, title, author, desc, genre, isbn) as books. `repair` undoes encoding damage."""
    none = F.lit(None)
    empty = F.array().cast("array<string>")
    return raw.select(
        "row_idx", work_id(F.col("isbn"), F.col("row_idx")).alias("work_id"), strip(repair(F.col("title"))).alias("title"),
        split_list(repair(F.col("author")), MAX_AUTHORS).alias("authors"), clean_description(strip(repair(F.col("desc")))).alias("description"),
        split_list(repair(F.col("genre")), MAX_SUBJECTS).alias("subjects"), none.cast("int").alias("first_publish_year"), none.cast("int").alias("cover_id"),
        F.nullif(strip(F.col("isbn")), F.lit("")).alias("isbn"), empty.alias("subject_places"), empty.alias("subject_people"), empty.alias("subject_times"),
        F.lit(1).alias("tier"), F.lit(SOURCE_NAME).alias("description_source"))


def unique_ids(books: DataFrame) -> DataFrame:
    """A repeated work_id gets its row's index as a suffix; the first keeps it."""
    w = W.partitionBy("work_id").orderBy("row_idx")
    again = F.row_number().over(w) > 1
    return books.withColumn("work_id", F.when(again, F.concat_ws("-", "work_id", F.col("row_idx").cast("string"))).otherwise(F.col("work_id")))


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "row_idx") -> DataFrame:
    """n rows without replacement, the same ones for a seed however the data are dealt, in key order."""
    return df.orderBy(draw(key, F.lit(seed)), key).limit(n).orderBy(key)


def build_corpus(raw: DataFrame, limit: int | None = None, seed: int = 42, keep_non_english: bool = False, lang: str | None = None, detect=None, repair=repair_text) -> DataFrame:
    rows = usable_rows(raw)
    if limit:
        rows = sample_rows(rows, limit, seed)
    if not keep_non_english:
        rows = english_rows(rows, lang=lang, detect=detect)
    return unique_ids(records(drop_ambiguous(rows), repair))


def indexed(books: DataFrame, tier: int | None = None) -> DataFrame:
    """Books with a description; with a tier, those up to it (a missing tier is none)."""
    out = books.where("description is not null and description <> ''")
    return out.where(F.coalesce("tier", F.lit(UNKNOWN_TIER)) <= tier) if tier else out


def search_filter(year_min: int | None = None, year_max: int | None = None, tier: int | None = None, year: str = "year") -> Column:
    """All conditions given; a null year never matches a range. Apply it before any top-k."""
    out = F.lit(True)
    if year_min is not None:
        out = out & (F.col(year) >= year_min)
    if year_max is not None:
        out = out & (F.col(year) <= year_max)
    return out & (F.col("tier") == tier) if tier is not None else out


def last_wins(df: DataFrame, *keys: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pool(lists: list[DataFrame], query: str = "query", key: str = "work_id") -> DataFrame:
    """Union of ranked lists, the first of repeated documents kept, in the order of lists and ranks."""
    out = None
    for i, part in enumerate(lists):
        one = part.select(query, key, "rank", F.lit(i).alias("source_order"))
        out = one if out is None else out.unionByName(one)
    kept = first_wins(out, [query, key], ["source_order", "rank"])
    return kept.withColumn("pos", F.row_number().over(W.partitionBy(query).orderBy("source_order", "rank")))


def slices(df: DataFrame, size: int = 500, start: int = 0, count: int | None = None, key: str = "row_idx") -> DataFrame:
    """Fixed blocks by position, a range of them on request."""
    out = df.withColumn("batch", F.floor(F.col(key) / size).cast("int"))
    out = out.where(F.col("batch") >= start)
    return out.where(F.col("batch") < start + count) if count is not None else out


def by_start(shards: DataFrame) -> DataFrame:
    """Shards in the order of the corpus."""
    return shards.orderBy("start_idx", "work_id")


def duplicate_examples(df: DataFrame, key: str = "work_id", most: int = 5) -> DataFrame:
    """One row: how many ids occur more than once, and the first few of them."""
    twice = df.groupBy(key).count().where("count > 1").select(key)
    some = twice.orderBy(key).limit(most).agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return twice.agg(F.count("*").alias("duplicates")).crossJoin(some)  # one row each


def missing(ids: DataFrame, known: DataFrame, key: str = "work_id") -> DataFrame:
    return ids.join(known.select(key), key, "left_anti")


def validate_index(vectors: DataFrame, books: DataFrame, dim: int, tolerance: float = 1e-2) -> DataFrame:
    """One row: rows, duplicate ids, vectors of a wrong size, ids not in the corpus, coverage, norms off 1."""
    eligible = indexed(books, 1)
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    shape = vectors.agg(F.count("*").alias("rows"), F.count_if(F.size("embedding") != dim).alias("wrong_dim"), F.count_if(F.abs(norm - 1) > tolerance).alias("off_norm"))
    twice = vectors.groupBy("work_id").count().where("count > 1").agg(F.count("*").alias("duplicates"))
    lost = missing(vectors.select("work_id"), books).agg(F.count("*").alias("missing"))
    size = eligible.agg(F.count("*").alias("eligible"))
    return shape.crossJoin(twice).crossJoin(lost).crossJoin(size).select("*", F.round(F.try_divide(F.col("rows"), F.col("eligible").cast("double")), 4).alias("coverage"))  # one row each


def check_index(report: DataFrame, allow_partial: bool = False) -> None:
    """Raise what makes an index unusable."""
    r = report.first()
    bad = [f"{r[c]} {what}" for c, what in (("wrong_dim", "vectors of a wrong size"), ("duplicates", "repeated ids"), ("missing", "ids not in the corpus"), ("off_norm", "vectors off unit length")) if r[c]]
    if not allow_partial and r["rows"] < r["eligible"]:
        bad.append(f"{r['eligible'] - r['rows']} books without a vector")
    if bad:
        raise ValueError("; ".join(bad))
