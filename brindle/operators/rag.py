"""Grounded answers: context from ranked hits, checks of an answer's citations. Answers come as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.rag import context_entry, unsupported_titles

MAX_SOURCES = 5
# Fixed value: the answer when nothing was found.
NO_HITS = "I couldn't find any relevant books for that question."


def build_context(hits: DataFrame, max_sources: int = MAX_SOURCES) -> DataFrame:
    """(qid, context, sources) from hits(qid, rank, title, authors, year, description, subjects, work_id)."""
    top = hits.where(F.col("rank") <= max_sources)
    entry = context_entry(F.col("rank"), F.col("title"), F.col("authors"), F.col("year"), F.col("description"), F.col("subjects"))
    source = F.struct("rank", "title", "authors", F.coalesce(F.col("year").cast("string"), F.lit("n.d.")).alias("year"), "work_id")
    rows = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("text"), source.alias("source")))).alias("parts"))
    return rows.select("qid", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("context"), F.transform("parts", lambda p: p["source"]).alias("sources"))


def validate(answers: DataFrame, sources: DataFrame, italic: bool = True) -> DataFrame:
    """Answers(qid, answer) against the sources of their query: citations_valid, hallucinated_titles."""
    joined = answers.join(sources.select("qid", F.transform("sources", lambda s: s["title"]).alias("titles")), "qid", "left")
    wrong = unsupported_titles(F.col("answer"), F.coalesce("titles", F.array().cast("array<string>")), italic)
    return joined.select("qid", "answer", wrong.alias("hallucinated_titles"), (F.size(wrong) == 0).alias("citations_valid"))


def ask(questions: DataFrame, hits: DataFrame, answer, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Context, answer by a Column function of (question, context), validation. No hit: a fixed answer."""
    context = build_context(hits, max_sources)
    joined = questions.join(context, "qid", "left")
    text = F.when(F.col("context").isNull(), F.lit(NO_HITS)).otherwise(answer(F.col("question"), F.col("context")))
    answered = joined.select("qid", text.alias("answer"))
    checked = validate(answered, context)
    return checked.join(context.select("qid", "sources"), "qid", "left").withColumn("citations_valid", F.col("citations_valid") | F.col("sources").isNull())
