"""A training corpus from `documents`: toxic, copied and nearly copied documents go, sources are mixed to
their weights, and the rest is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.exact_dedup import drop_exact
from brindle.llm.mixing import mix_documents
from brindle.llm.packing import pack_documents
from brindle.llm.shared import Scratch, table
from brindle.llm.simhash import drop_similar
from brindle.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go. It learns from the labelled rows of docs. Null and
    empty texts get the base rate and stay; repeated rows are judged each; an empty table stays empty."""
    return drop_toxic(docs, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest original stays, then the smallest doc_id (null
    last). Null counts as empty; of wholly equal rows one stays; an empty table stays empty."""
    return drop_exact(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest doc_id (null last). Near are five-word
    shingles of a Jaccard similarity of 0.8 or more; texts without words are one group. Whole texts count."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: documents come as often as the mix takes them, or in part. Those
    without a word (null, empty) go; a null source is one, last; columns stay as they are."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. A null or empty text is a piece of the end id alone;
    only texts longer than a sequence are cut."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]

#: A learned model and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
