"""The search engine: an index of tables, and batch search over it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.intent import classify
from brindle.functions.text import combined_text, cover_url, join_authors, passage, query_text
from brindle.operators import dense, ranking, rag, sparse, spelling
from brindle.operators.etl import search_filter
from brindle.sources.scratch import saved

MODES = ("hybrid", "vector", "keyword")
# Bounds of the comparison's depth and of a question's length.
MAX_COMPARE = 20
QUESTION_LENGTH = (3, 500)


@dataclass(frozen=True)
class Settings:
    """Sizes and depths. The fusion constants are those of the served system."""

    dim: int = 256
    slice_rows: int = 500
    rrf_k: int = 2
    rrf_base: int = 0
    rerank_multiplier: float = 2.5
    max_top_k: int = 50
    queue_backend: str = "files"
    store_backend: str = "local"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Sizes and backends from the environment, where they are set."""
        env = dict(os.environ) if env is None else env
        names = {"EMBED_DIM": ("dim", int), "BATCH_CHUNK_SIZE": ("slice_rows", int), "QUEUE_BACKEND": ("queue_backend", str), "OBJECT_STORE_BACKEND": ("store_backend", str)}
        return cls(**{field: kind(env[name]) for name, (field, kind) in names.items() if env.get(name)})


@dataclass
class Index:
    """Books, postings, vocabulary and vectors. Without postings (`text_index`) keyword search reads the books."""

    books: DataFrame
    postings: DataFrame | None
    vocabulary: DataFrame
    vectors: DataFrame

    TABLES = ("books", "postings", "vocabulary", "vectors")

    def save(self, path: str, recreate: bool = False) -> None:
        """Postings are clustered by term, so that a search reads the row groups of its terms."""
        mode = "overwrite" if recreate else "errorifexists"
        for name in self.TABLES:
            df = getattr(self, name)
            (df.repartition("term").sortWithinPartitions("term") if name == "postings" else df).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """The saved tables; books that were added since take the place of those with their id."""
        from brindle.sources.backends import ObjectStore
        from brindle.sources.tables import upsert

        main = {n: spark.read.parquet(f"{path}/{n}") for n in cls.TABLES}
        if ObjectStore(spark, path).exists("added/books"):
            new = {n: spark.read.parquet(f"{path}/added/{n}") for n in cls.TABLES}
            ids = new["books"].select("work_id")
            main["postings"] = main["postings"].join(ids, "work_id", "left_anti").unionByName(new["postings"].select(*main["postings"].columns))
            fresh = new["vocabulary"].join(main["vocabulary"].select("term"), "term", "left_anti")
            main["vocabulary"] = main["vocabulary"].unionByName(fresh.select(*main["vocabulary"].columns))
            for n in ("books", "vectors"):
                main[n] = upsert(main[n], new[n].select(*main[n].columns))
        return cls(**main)


def build_index(books: DataFrame, vectors: DataFrame) -> Index:
    """Fit the sparse arm over the whole corpus; `vectors(work_id, embedding)` are unit vectors."""
    counts = sparse.term_counts(books, "work_id", _indexed_text())
    vocabulary = sparse.fit_vocabulary(counts, books.count())
    return Index(_payload(books), sparse.weigh(counts, vocabulary, "work_id"), vocabulary, _units(vectors))


def text_index(books: DataFrame, vectors: DataFrame) -> Index:
    """As `build_index`, for few searches: the vocabulary alone is written, and books are weighed where they are
    read. It can't be saved."""
    return Index(_payload(books), None, sparse.text_vocabulary(books, "work_id", _indexed_text()), _units(vectors))


def _indexed_text() -> Column:
    return combined_text(F.col("title"), F.col("description"), F.col("subjects"))


def _payload(books: DataFrame) -> DataFrame:
    return books.withColumn("year", F.col("first_publish_year")).withColumn("cover_url", cover_url(F.col("cover_id"), F.col("isbn"))).withColumn("authors", join_authors(F.col("authors")))


def _units(vectors: DataFrame) -> DataFrame:
    return vectors.select("work_id", dense.normalize(F.col("embedding")).alias("embedding"))


def add_books(spark: SparkSession, path: str, books: DataFrame, vectors: DataFrame) -> None:
    """Add a slice of books to a saved index, over those of the same ids. Its sparse weights come from the slice's
    own counts: the vocabulary of the whole is fitted when the index is built."""
    from brindle.sources.tables import write_upsert

    new = build_index(books, vectors)
    for name in ("books", "vectors"):
        write_upsert(spark, getattr(new, name), f"{path}/added/{name}")
    write_upsert(spark, new.postings, f"{path}/added/postings", unique=False)
    write_upsert(spark, new.vocabulary, f"{path}/added/vocabulary", key="term")


def understand(queries: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Queries(qid, query) corrected and classified; the intent is reported and doesn't route."""
    fixed = spelling.correct(queries, dictionary) if dictionary is not None else queries.select("qid", "query", F.col("query").alias("corrected"), F.lit(False).alias("was_corrected"))
    return fixed.select("qid", F.col("query").alias("original"), "corrected", "was_corrected", classify(F.col("corrected")).alias("a")).select("qid", "original", "corrected", "was_corrected", "a.*")


class Engine:
    """Batch search over an index. `embed` maps a text Column to a vector Column."""

    def __init__(self, index: Index, embed: Callable[[Column], Column] | None = None, settings: Settings | None = None, dictionary: DataFrame | None = None, scorer: Callable[[Column, Column], Column] | None = None):
        self.index, self.settings, self.dictionary, self.scorer = index, settings or Settings(), dictionary, scorer
        self.embed = embed or (lambda c: dense.hashed_embedding(c, self.settings.dim))

    def _check(self, top_k: int, mode: str, tier: int | None) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown search mode {mode}")
        if not 1 <= top_k <= self.settings.max_top_k:
            raise ValueError(f"top_k is 1 to {self.settings.max_top_k}")
        if tier is not None and not 1 <= tier <= 3:
            raise ValueError("tier is 1 to 3")

    def _arms(self, queries: DataFrame, mode: str, depth: int, year_min: int | None, year_max: int | None, tier: int | None) -> dict[str, DataFrame]:
        """Ranked arms over the books that pass the filters: these come before any cut."""
        plain = year_min is None and year_max is None and tier is None
        some = self.index.books if plain else self.index.books.where(search_filter(year_min, year_max, tier))
        books = None if plain else some.select("work_id")
        arms = {}
        if mode in ("vector", "hybrid"):
            vectors = self.index.vectors if books is None else self.index.vectors.join(books, "work_id", "left_semi")
            asked = queries if "vector" in queries.columns else queries.withColumn("vector", self.embed(query_text(F.col("query"))))
            q = asked.select("qid", dense.truncate(F.col("vector"), self.settings.dim).alias("vector"))
            arms["vector"] = dense.vector_top_k(vectors.withColumnRenamed("embedding", "vector"), q, depth, key="work_id")
        if mode in ("keyword", "hybrid") and self.index.postings is None:
            arms["keyword"] = saved(sparse.text_search(some, self.index.vocabulary, queries, depth, "work_id", _indexed_text()), "arm")
        elif mode in ("keyword", "hybrid"):
            postings = self.index.postings if books is None else self.index.postings.join(books, "work_id", "left_semi")
            weights = sparse.weigh(sparse.term_counts(queries, "qid", F.col("query")), self.index.vocabulary, "qid")
            arms["keyword"] = ranking.top_k(sparse.keyword_scores(postings, weights, "work_id"), depth, ["qid"], key="work_id")
        return arms

    def search(self, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", year_min: int | None = None, year_max: int | None = None, tier: int | None = None, rerank: bool = False, understanding: bool = False, explain: bool = False) -> DataFrame:
        """(qid, rank, work_id, score, ...) for queries(qid, query[, vector]). Without a scorer, reranking is
        left out. `explain` adds each arm's rank."""
        self._check(top_k, mode, tier)
        if understanding:
            queries = queries.drop("query").join(understand(queries, self.dictionary).select("qid", F.col("corrected").alias("query")), "qid")
        again = rerank and self.scorer is not None
        fetch = ranking.rerank_depth(top_k, self.settings.rerank_multiplier) if again else top_k
        arms = self._arms(queries, mode, 2 * fetch if mode == "hybrid" else fetch, year_min, year_max, tier)
        if mode == "hybrid":
            fused = ranking.reciprocal_rank_fusion(list(arms.values()), ["qid"], "work_id", self.settings.rrf_k, self.settings.rrf_base)
            hits = ranking.top_k(fused, fetch, ["qid"], key="work_id")
        else:
            hits = arms[mode]
        hits = hits.select("qid", "work_id", "score", "rank")
        rows = None
        if self.index.postings is None:  # written once and counted, so that books aren't shuffled for them
            hits = saved(hits, "hits")
            rows = hits.count()
        if explain:
            for name, arm in arms.items():
                hits = hits.join(arm.select("qid", "work_id", F.col("rank").alias(f"{name}_rank")), ["qid", "work_id"], "left")
        columns = ["title", "authors", "description", "subjects", "year", "cover_url", "tier"]
        shown = self.index.books.join(ranking.small_side(hits, rows), "work_id").select("qid", "rank", "work_id", "score", *columns, *[c for c in hits.columns if c.endswith("_rank")])
        shown = shown.na.fill("", ["title", "authors"]).withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))
        if again:
            text = passage(F.col("title"), F.col("authors"), F.col("description"), F.col("subjects"))
            asked = shown.join(queries.select("qid", "query"), "qid")
            shown = ranking.rerank(asked, self.scorer(F.col("query"), text), top_k, ["qid"]).drop("query")
        return shown

    def compare(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """(mode, qid, rank, work_id, title, score, year) of all modes."""
        if not 1 <= top_k <= MAX_COMPARE:
            raise ValueError(f"top_k is 1 to {MAX_COMPARE}")
        out = None
        for mode in MODES:
            part = self.search(queries, top_k, mode).select(F.lit(mode).alias("mode"), "qid", "rank", "work_id", "title", F.round("score", 4).alias("score"), "year")
            out = part if out is None else out.unionByName(part)
        return out

    def ask(self, questions: DataFrame, answer: Callable[[Column, Column], Column], max_sources: int = 5, mode: str = "hybrid") -> DataFrame:
        """Answers with their sources checked, for questions(qid, question)."""
        if not 1 <= max_sources <= 10:
            raise ValueError("max_sources is 1 to 10")
        some = questions.where(F.length("question").between(*QUESTION_LENGTH))
        if not questions.join(some.select("qid"), "qid", "left_anti").where("question <> ''").isEmpty():
            raise ValueError("a question has {} to {} characters".format(*QUESTION_LENGTH))
        hits = self.search(some.select("qid", F.col("question").alias("query")), 2 * max_sources, mode, rerank=True)
        return rag.ask(questions, hits, answer, max_sources)

    def _tables(self) -> list[str]:
        return [n for n in Index.TABLES if n != "postings" or self.index.postings is not None]

    def health(self) -> dict:
        """Whether the parts are there; never an error."""
        parts = {}
        for name in self._tables():
            try:
                getattr(self.index, name).schema  # noqa: B018
                parts[name] = "ok"
            except Exception as e:  # noqa: BLE001
                parts[name] = f"{type(e).__name__}: {e}"[:200]
        return {"status": "ok" if set(parts.values()) == {"ok"} else "degraded", "parts": parts}

    def ready(self) -> bool:
        """Whether a search can run: every table can be read and the embedder answers."""
        try:
            for name in self._tables():
                getattr(self.index, name).limit(1).collect()
            self.index.books.sparkSession.range(1).select(self.embed(F.lit("probe"))).collect()
            return True
        except Exception:  # noqa: BLE001
            return False

    def stats(self) -> dict:
        return {"points": self.index.books.count(), "dim": self.settings.dim, "terms": self.index.vocabulary.count()}


def lexical_scorer(query: Column, text: Column) -> Column:
    """An offline stand-in for a pair model: the share of a query's words that the passage has."""
    from brindle.functions.text import sparse_tokens

    q, p = F.array_distinct(sparse_tokens(query)), F.array_distinct(sparse_tokens(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, p)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def model_scorer(predict: Callable[[list[str], list[str]], list[float]], batch: int = 4):
    """A scorer from any pair model. Pairs go to it by their words, so that little is padded, and come back in
    their own places."""
    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in parts:
            order = (q.fillna("").str.split().str.len() + p.fillna("").str.split().str.len()).argsort(kind="stable").to_numpy()
            out = pd.Series(0.0, index=range(len(p)))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                out.iloc[at] = predict(q.iloc[at].tolist(), p.iloc[at].tolist())
            yield out

    return score
