"""Seeded samples that don't depend on how rows are dealt, and evaluation query sets."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brindle.functions import querygen as G
from brindle.functions.text import ascii_tokens, draw, plain_id, searchable_text, strip, title_tokens


def stratified(df: DataFrame, strata: list[str], n: int, seed: int, key: str) -> DataFrame:
    """n rows dealt round-robin over strata: the first of each, then the second of each, by hashes."""
    inside = W.partitionBy(*strata).orderBy(draw(key, F.lit(seed)), key)
    turn = df.withColumn("__turn", F.row_number().over(inside)).where(F.col("__turn") <= n)
    return turn.orderBy("__turn", draw(*strata, F.lit(seed)), key).limit(n).drop("__turn")


def seed_books(books: DataFrame, n: int, seed: int) -> DataFrame:
    keyed = books.withColumn("stratum", F.concat_ws("|", G.broad_genre(F.col("subjects")), G.length_bucket(F.col("description")), G.year_bucket(F.col("first_publish_year"))))
    return stratified(keyed, ["stratum"], n, seed, "work_id")


def category_counts(n: int) -> dict[str, int]:
    """Rows for each category; halves round to even; cut or filled to n in the order of categories."""
    out, left = {}, n
    for c, w in G.CATEGORY_WEIGHTS.items():
        out[c] = min(round(n * w), left)
        left -= out[c]
    for c in list(G.CATEGORY_WEIGHTS) * (left + 1):
        if left <= 0:
            break
        out[c] += 1
        left -= 1
    return out


def assign_categories(seeds: DataFrame, n: int, seed: int, key: str = "work_id") -> DataFrame:
    """A category for each of n seed books, by a hash order. `seeds` has n rows, a query set's size."""
    order = W.partitionBy(F.lit(0)).orderBy(draw(key, F.lit(seed), F.lit("category")), key)
    at, chain = 0, None
    for c, count in category_counts(n).items():
        hit = F.col("__n") <= at + count
        chain = F.when(hit, c) if chain is None else chain.when(hit, c)
        at += count
    return seeds.withColumn("__n", F.row_number().over(order)).withColumn("category", chain).drop("__n")


def label_pairs(judgments: DataFrame, pooled: DataFrame, n: int, seed: int, strategy: str = "stratified") -> DataFrame:
    """Pairs for people to grade, with the document's fields: random, or round-robin over grades."""
    known = judgments.where("grade is not null").select("query", "work_id", F.col("grade").alias("llm_grade"))
    both = known.join(pooled, ["query", "work_id"]).withColumn("pair", F.concat_ws("||", "query", "work_id"))
    if strategy == "random":
        return both.orderBy(draw("pair", F.lit(seed)), "pair").limit(n).drop("pair")
    w = W.partitionBy("llm_grade").orderBy(draw("pair", F.lit(seed)), "pair")
    return both.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", "llm_grade").limit(n).drop("turn", "pair")


def document_frequency(docs: DataFrame, key: str, tokens) -> DataFrame:
    """(term, df): documents that hold a term; repeats in one are dropped before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_df(books: DataFrame) -> DataFrame:
    return document_frequency(books, "work_id", ascii_tokens(searchable_text(F.col("title"), F.col("authors"), F.col("subjects"), F.col("description"))))


def title_df(books: DataFrame) -> DataFrame:
    return document_frequency(books, "work_id", title_tokens(F.concat_ws(" ", "title", "description")))


def author_index(books: DataFrame) -> DataFrame:
    """(author, work_id), long: no author's books are ever gathered into one row."""
    return books.select(F.explode("authors").alias("name"), "work_id").select(G.normalize_author(F.col("name")).alias("author"), "work_id").where("author <> ''").distinct()


def author_gold(seeds: DataFrame, index: DataFrame, cap: int = G.GOLD_CAP) -> DataFrame:
    """(seed_id, gold_work_ids): all books of a seed's authors; over `cap` of them the names are too
    common and the seed stands alone. Each author's books are cut to cap + 1 before the join, which
    tells as much, so the join never holds more than that for a seed's author."""
    per = W.partitionBy("author").orderBy("work_id")
    few = index.withColumn("n", F.row_number().over(per)).where(F.col("n") <= cap + 1).drop("n")
    asked = seeds.select(F.col("work_id").alias("seed_id"), F.explode("authors").alias("name")).select("seed_id", G.normalize_author(F.col("name")).alias("author")).distinct()
    sets = asked.join(few, "author").groupBy("seed_id").agg(F.sort_array(F.collect_set("work_id")).alias("ids"))
    out = seeds.select(F.col("work_id").alias("seed_id")).join(sets, "seed_id", "left")
    return out.select("seed_id", F.when(F.coalesce(F.size("ids"), F.lit(0)).between(1, cap), F.col("ids")).otherwise(F.array("seed_id")).alias("gold_work_ids"))


def rare_overlap(pairs: DataFrame, df: DataFrame, n_docs: int, query: str = "query", document: str = "document", key: str = "pair_id") -> DataFrame:
    """(key, rare_term_overlap): the part of a query's content words that are rare and in the document."""
    limit = max(1, int(n_docs * G.RARE_SHARE))
    words = pairs.select(key, F.array_distinct(G.content_tokens(F.col(query))).alias("q"), F.array_distinct(G.content_tokens(F.col(document))).alias("d"))
    each = words.select(key, F.size("q").alias("n"), F.explode("q").alias("term"), "d").select(key, "n", "term", F.array_contains("d", F.col("term")).alias("inside"))
    rare = each.join(df.where(F.col("df") >= limit).select("term", F.lit(True).alias("common")), "term", "left")
    got = rare.groupBy(key).agg(F.round(F.count_if(F.col("inside") & F.col("common").isNull()) / F.max("n"), 4).alias("rare_term_overlap"))
    return pairs.select(key).join(got, key, "left").na.fill(0.0, ["rare_term_overlap"])


def drop_near_duplicate_queries(rows: list[dict], threshold: float = G.NEAR_DUPLICATE) -> list[dict]:
    """Greedy and in order: a query goes if its `dedup_form` is too close to that of one kept before. A query
    set has hundreds of rows, each already on the driver."""
    kept: list[dict] = []
    for row in rows:
        if all(SequenceMatcher(None, row["dedup_form"], k["dedup_form"]).ratio() < threshold for k in kept):
            kept.append(row)
    return kept


def query_candidates(books: DataFrame, n: int, seed: int, attempts: int = 3) -> DataFrame:
    """Template queries for 2n seed books, some tries each, with leakage and difficulty."""
    seeds = assign_categories(seed_books(books, 2 * n, seed), 2 * n, seed)
    tries = seeds.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    key = draw("work_id", "attempt", F.lit(seed))
    made = tries.withColumn("query", strip(G.template_query(F.col("category"), F.col("title"), F.col("authors"), F.col("subjects"), F.col("description"), F.col("first_publish_year"), key)))
    made = made.where("query is not null and query <> ''")
    doc = searchable_text(F.col("title"), F.col("authors"), F.col("subjects"), F.col("description"))
    ratio = G.sequence_ratio(F.lower("query"), F.lower("title"))
    return made.select(
        "work_id", "title", "authors", "subjects", "category", "attempt", "query", G.dedup_form(F.col("query")).alias("dedup_form"), doc.alias("document"), G.gold_is_complete(F.col("category")).alias("gold_is_complete"),
        G.jaccard(F.col("query"), doc).alias("unigram_jaccard"), G.longest_shared_run(F.col("query"), doc).alias("max_verbatim_ngram"),
        G.difficulty(F.col("category"), F.col("query"), F.col("title"), F.col("authors"), F.col("subjects"), F.col("first_publish_year"), ratio).alias("difficulty"))


def query_set(books: DataFrame, n: int, seed: int = 42, max_ngram: int | None = None) -> list[dict]:
    """An evaluation query set of at most n queries, as rows: one for each seed book, no near-duplicates,
    none that copies a run of `max_ngram` words from its book."""
    some = query_candidates(books, n, seed)
    if max_ngram:
        some = some.where(F.col("max_verbatim_ngram") < max_ngram)
    gold = author_gold(some.select("work_id", "authors").distinct(), author_index(books))
    rows = some.drop("document").join(gold, some["work_id"] == gold["seed_id"]).drop("seed_id").orderBy(draw("work_id", F.lit(seed)), "attempt").collect()
    used, out = set(), []
    for r in (x.asDict() for x in rows):
        if len(out) < n and r["work_id"] not in used and len(drop_near_duplicate_queries([*out, r])) > len(out):
            used.add(r["work_id"])
            r["gold_work_ids"] = r["gold_work_ids"] if r["category"] == "author" else [r["work_id"]]
            out.append(r | {"source": "template"})
    return out


def percentile_by_index(df: DataFrame, group: list[str], value: str, p: float) -> DataFrame:
    """(*group, value): of each group's sorted values the one at index floor(n p), at most the last. Counts of
    equal values are summed up, so no group's values are gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    up = W.partitionBy(*group).orderBy(value)
    total = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
    ranked = counts.withColumn("__upto", F.sum("__n").over(up)).join(total, group)
    at = F.least(F.floor(F.col("__total") * F.lit(p)), F.col("__total") - 1)
    return ranked.where(F.col("__upto") > at).groupBy(*group).agg(F.min(value).alias(value))


def gold_count(queries: DataFrame, gold: str = "gold_work_ids") -> DataFrame:
    """One row: how many different documents are gold for some query."""
    return queries.select(F.explode(gold).alias("id")).agg(F.countDistinct("id").alias("gold_documents"))


def known_items(books: DataFrame, count: int = 50, seed: int = 42, threshold: float = 0.005) -> DataFrame:
    """Distinctive titles that occur once, sampled by hash, with the class of their words: distinctive if
    one of them is in under `threshold` of all books."""
    some = books.where(F.col("description").isNotNull() & (F.col("description") != ""))
    alone = some.groupBy(F.lower(strip(F.col("title"))).alias("t")).agg(F.count("*").alias("c"), F.first("work_id").alias("id")).where("c = 1").select(F.col("id").alias("work_id"))
    fit = some.where(G.distinctive_title(F.col("title"))).join(alone, "work_id", "left_semi")
    items = fit.orderBy(draw("work_id", F.lit(seed)), "work_id").limit(count).select(plain_id(F.col("work_id")).alias("work_id"), F.col("title").alias("query"), "title", "authors")
    return items.join(title_class(items, title_df(some), some.count(), threshold), "work_id")


def title_class(items: DataFrame, df: DataFrame, n_docs: int, threshold: float = 0.005) -> DataFrame:
    words = items.select("work_id", F.explode(title_tokens(F.col("title"))).alias("term")).join(df, "term", "left")
    rare = words.groupBy("work_id").agg(F.bool_or(F.coalesce("df", F.lit(0)) / F.lit(float(n_docs)) < threshold).alias("rare"))
    return items.select("work_id").join(rare, "work_id", "left").select("work_id", F.when(F.col("rare"), "distinctive").otherwise("common_words").alias("title_word_class"))


def hard_variants(items: DataFrame, count: int = 10, seed: int = 42) -> DataFrame:
    """Partial title, typo, and title with author of some items."""
    some = items.orderBy(draw("work_id", F.lit(seed), F.lit("hard")), "work_id").limit(count)
    author = F.get("authors", F.lit(0))
    kinds = F.array(
        F.struct(G.known_item_partial(F.col("title")).alias("query"), F.lit("partial_title").alias("variant_type")),
        F.struct(G.known_item_typo(F.col("title"), F.col("work_id"), F.lit(seed)).alias("query"), F.lit("typo").alias("variant_type")),
        F.struct(F.concat_ws(" ", "title", author).alias("query"), F.when(F.nullif(author, F.lit("")).isNotNull(), "title_plus_author").alias("variant_type")))
    return some.select("work_id", "title", F.explode(kinds).alias("v")).select("v.query", "work_id", "title", "v.variant_type").where("variant_type is not null")
