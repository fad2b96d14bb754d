"""Sources and sinks: books, vectors, shards, dictionaries, judgments, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.judging import grade_of
from brindle.functions.text import plain_id
from brindle.operators.etl import UNKNOWN_TIER, indexed, last_wins

BOOK = T.StructType([
    T.StructField("work_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("description", T.StringType()),
    T.StructField("subjects", T.ArrayType(T.StringType())), T.StructField("first_publish_year", T.IntegerType()), T.StructField("cover_id", T.IntegerType()), T.StructField("isbn", T.StringType()),
    T.StructField("subject_places", T.ArrayType(T.StringType())), T.StructField("subject_people", T.ArrayType(T.StringType())), T.StructField("subject_times", T.ArrayType(T.StringType())),
    T.StructField("tier", T.IntegerType()), T.StructField("description_source", T.StringType())])
RAW_BOOK = "row_idx long, title string, author string, desc string, genre string, isbn string"
SHARD = "batch_id string, start_idx long, work_id string, embedding array<float>"
TASK = "batch_id string, blob_path string, start_idx int, end_idx int"

# Marks of files that hold published results, which nothing may overwrite.
ARCHIVED = (".v1-openlibrary", "_v1.", ".v1.")


# ---- sources

def raw_books(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw rows with their index, which is part of the data: it gives rows without an ISBN their id."""
    return spark.read.schema(RAW_BOOK).format(kind).load(path)


def books(spark: SparkSession, path: str, tier: int | None = None) -> DataFrame:
    """Books from JSON lines; a tier keeps books up to it, and 0 is no filter."""
    out = spark.read.schema(BOOK).json(path)
    return out.where(F.coalesce("tier", F.lit(UNKNOWN_TIER)) <= tier) if tier else out


def indexed_books(spark: SparkSession, path: str) -> DataFrame:
    return indexed(books(spark, path))


def corpus(spark: SparkSession, path: str, order: str = "row_idx") -> DataFrame:
    """Books by work_id, the last of equal ones counting. Lines need an index column for that."""
    schema = T.StructType([*BOOK.fields, T.StructField(order, T.LongType())])
    return last_wins(spark.read.schema(schema).json(path), "work_id", order=order)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(work_id, embedding). Anything but arrays of numbers is an old format and refused."""
    df = spark.read.parquet(path)
    if "embedding" not in df.columns or not isinstance(df.schema["embedding"].dataType, T.ArrayType):
        raise ValueError(f"{path} has no column of embedding arrays")
    return df


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def npz_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards in numpy's archive format, any file system that Spark reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.load(io.BytesIO(content), allow_pickle=False)
                ids, rows = z["work_ids"].astype(str).tolist(), z["embeddings"].astype(np.float32)
                if len(ids) != len(rows):
                    raise ValueError(f"{name}: {len(rows)} vectors for {len(ids)} ids")
                yield pa.record_batch([pa.array([name.rsplit("/", 1)[-1].removesuffix(".npz")] * len(ids)), pa.array([int(z["start_idx"])] * len(ids), pa.int64()), pa.array(ids), pa.array(list(rows), pa.list_(pa.float32()))], names=["batch_id", "start_idx", "work_id", "embedding"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInArrow(run, SHARD)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) from lines of a term and a count."""
    part = F.split(F.col("value"), r"\s+")
    return spark.read.text(path).select(F.get(part, F.lit(0)).alias("term"), F.get(part, F.lit(1)).try_cast("long").alias("freq")).where("term <> '' and freq is not null")


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object of query to `value` (a DDL type) as rows (query, value); what can't be read is empty."""
    text = spark.read.option("wholetext", True).text(path)
    read = F.from_json("value", f"map<string, {value}>")
    return text.select(F.explode(F.coalesce(read, F.create_map().cast(f"map<string, {value}>"))).alias("query", "value"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query, pos, work_id, title, grade): the newer field before the older one."""
    rows = keyed_json(spark, path, "array<struct<work_id: string, title: string, grade: int, relevance: int>>")
    return rows.select("query", F.posexplode("value").alias("pos", "j")).select("query", "pos", "j.work_id", "j.title", grade_of(F.col("j.grade"), F.col("j.relevance")).alias("grade"))


def pooled(spark: SparkSession, path: str) -> DataFrame:
    rows = keyed_json(spark, path, "array<struct<work_id: string, title: string, authors: string, subjects: array<string>, description: string>>")
    return rows.select("query", F.posexplode("value").alias("pos", "d")).select("query", "pos", "d.*")


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """(mode, query, rank, work_id) from mode to query to ids."""
    rows = keyed_json(spark, path, "map<string, array<string>>").withColumnRenamed("query", "mode")
    return rows.select("mode", F.explode("value").alias("query", "ids")).select("mode", "query", F.posexplode("ids").alias("pos", "work_id")).select("mode", "query", (F.col("pos") + 1).alias("rank"), "work_id")


def known_item_rows(spark: SparkSession, path: str, kind: str = "items") -> DataFrame:
    """(query, work_id, title, class) of a known-item file: its items or its hard variants. A field that isn't
    there is null; a file that can't be read is empty."""
    row = "array<struct<query: string, work_id: string, title: string, title_word_class: string, variant_type: string>>"
    text = spark.read.option("wholetext", True).text(path)
    read = F.from_json("value", f"items {row}, hard_variants {row}")
    field = "items" if kind == "items" else "hard_variants"
    return text.select(F.explode(read[field]).alias("i")).select("i.query", plain_id(F.col("i.work_id")).alias("work_id"), "i.title", F.coalesce("i.variant_type", "i.title_word_class").alias("class"))


def judge_cache(spark: SparkSession, path: str) -> DataFrame:
    """(pair_key, grade, reasoning) of a cache file; one that can't be read is empty."""
    rows = keyed_json(spark, path, "struct<grade: int, reasoning: string>")
    return rows.select(F.col("query").alias("pair_key"), "value.grade", "value.reasoning")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(query, work_id, grade) of labels given so far; a file that can't be read is empty."""
    read = F.from_json("value", "array<struct<query: string, work_id: string, grade: int, relevance: int>>")
    return spark.read.option("wholetext", True).text(path).select(F.explode(read).alias("l")).select("l.query", "l.work_id", grade_of(F.col("l.grade"), F.col("l.relevance")).alias("grade"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    schema = "created_at string, git_sha string, item_count int, seed int, max_drop_pp double, gated_modes array<string>, modes map<string, struct<accuracy_at_1: double, accuracy_at_5: double, mrr: double>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("modes").alias("mode", "m"), "gated_modes", "max_drop_pp").select("mode", "m.*", "gated_modes", "max_drop_pp")


def synthetic_pool(spark: SparkSession, queries: int = 8, per_query: int = 5, titles: int = 10) -> DataFrame:
    """A made-up pool: titles in a cycle of three for each query."""
    q, d = spark.range(queries).withColumnRenamed("id", "qi"), spark.range(per_query).withColumnRenamed("id", "di")
    at = F.pmod(F.col("qi") * 3 + F.col("di"), F.lit(titles))
    return q.join(d).select(F.concat(F.lit("query "), F.col("qi").cast("string")).alias("query"), F.col("di").cast("int").alias("pos"), F.concat(F.lit("synthetic-"), at.cast("string")).alias("work_id"), F.concat(F.lit("Title "), at.cast("string")).alias("title"))


# ---- sinks

def guard(path: str, force: bool = False) -> str:
    if not force and any(mark in path for mark in ARCHIVED):
        raise FileExistsError(f"{path} is an archived result")
    return path


def write_books(df: DataFrame, path: str) -> None:
    df.select(*[f.name for f in BOOK.fields]).write.mode("overwrite").json(guard(path))


def write_shards(df: DataFrame, path: str) -> None:
    """By batch: a batch that is written again replaces itself and nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_index(vectors: DataFrame, path: str) -> int:
    """Write, read back and count."""
    before = vectors.count()
    vectors.write.mode("overwrite").parquet(path)
    after = vectors.sparkSession.read.parquet(path).count()
    if after != before:
        raise OSError(f"{path} holds {after} rows of {before}")
    return after


def write_dictionary(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "term", F.col("freq").cast("string")).alias("value")).sort("value").write.mode("overwrite").text(path)


def write_audit(df: DataFrame, path: str) -> None:
    from brindle.operators.agreement import audit_order

    flat = audit_order(df).withColumn("samples", F.col("samples").cast("string"))
    flat.select("query", "work_id", "title", "grade", "reasoning", "samples", "k_requested", "n_samples_ok", "agreement", "low_confidence", "contradiction", "contradiction_detail").write.mode("overwrite").option("header", True).csv(guard(path))


def write_report(rows: dict | list, path: str) -> None:
    """A report of few rows as a JSON file, on any file system that Spark reaches."""
    from brindle.sources.backends import ObjectStore

    folder, _, name = guard(path).rpartition("/")
    ObjectStore(SparkSession.active(), folder or ".").put_bytes(name, json.dumps(rows, indent=2, ensure_ascii=False, default=str).encode())


def write_with_meta(rows: list, path: str, meta: dict) -> None:
    """A report and, beside it, what made it: `.meta.json`."""
    write_report(rows, path)
    write_report(meta | {"rows": len(rows)}, f"{path.removesuffix('.json')}.meta.json")


def upsert(table: DataFrame, new: DataFrame, key: str = "work_id", unique: bool = True) -> DataFrame:
    """Rows of `new` in place of those with the same key; with `unique`, one of those with equal keys."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]) if unique else new)


def write_upsert(spark: SparkSession, new: DataFrame, path: str, key: str = "work_id", buckets: int = 64, unique: bool = True) -> None:
    """Upsert into a table on disk that is kept in buckets of its key: only the buckets of new rows are read
    and written again."""
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    some = new.select("*", at).persist()
    try:
        touched = [r["bucket"] for r in some.select("bucket").distinct().collect()]  # `buckets` numbers at most
        try:
            old = spark.read.parquet(path).where(F.col("bucket").isin(*touched))
        except AnalysisException:
            old = some.limit(0)
        merged = upsert(old.select(*some.columns), some, key, unique)
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        some.unpersist()


def to_kafka(tasks: DataFrame, servers: str, topic: str) -> None:
    """Tasks as messages keyed by batch, with their headers if they have some; needs Spark's Kafka package on the
    class path. `tasks` holds key and value already, or the fields of a task."""
    headers = [F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("binary").alias("value"))).alias("headers")] if "headers" in tasks.columns else []
    body = [c for c in tasks.columns if c != "headers"]
    made = [F.col("key"), F.col("value")] if {"key", "value"} <= set(body) else [F.col("batch_id").alias("key"), F.to_json(F.struct(*body)).alias("value")]
    tasks.select(*made, *headers).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.enable.idempotence", "true").option("kafka.acks", "all").option("topic", topic).save()
