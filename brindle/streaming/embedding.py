"""The embedding queue as a stream: slices of books in, shards of vectors out, at least once and each
slice written in place of itself; and the same work task by task from a queue."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brindle.functions.text import clean_description, embedding_text
from brindle.operators.dense import truncate
from brindle.operators.etl import indexed, slices
from brindle.sources.backends import TRACE, FileQueue, KafkaQueue, Message, ObjectStore, trace_headers, trace_of
from brindle.sources.tables import BOOK, write_shards

SLICE_ROWS = 500
IDLE_SECONDS = 30.0
#: Tasks that a looping worker does in one job.
TASKS_AT_ONCE = 128


def slice_schema() -> T.StructType:
    return T.StructType([*BOOK.fields, T.StructField("row_idx", T.LongType()), T.StructField("batch_id", T.StringType())])


def _sliced(books: DataFrame, size: int, start: int, count: int | None) -> DataFrame:
    return slices(books, size, start, count).withColumn("batch_id", F.format_string("batch-%06d", F.col("batch"))).drop("batch")


def enqueue(books: DataFrame, path: str, size: int = SLICE_ROWS, start: int = 0, count: int | None = None) -> None:
    """Producer: slices by position as files, which are the queue: a slice is there before it is seen, and
    one that is put in again replaces itself."""
    some = _sliced(books, size, start, count)
    some.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").json(path)


def send_tasks(books: DataFrame, store: ObjectStore, queue: FileQueue | KafkaQueue, size: int = SLICE_ROWS, start: int = 0, count: int | None = None, prefix: str = "slices") -> int:
    """Producer for a task queue: each slice is stored first and sent then, with a trace of its own. The tasks
    are a row for each slice of a bounded run."""
    some = _sliced(books, size, start, count)
    some.repartition("batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").json(f"{store.root}/{prefix}")
    tasks = some.groupBy("batch_id").agg(F.min("row_idx").alias("start_idx"), (F.max("row_idx") + 1).alias("end_idx")).orderBy("batch_id").collect()
    queue.ensure()
    for t in tasks:
        queue.send({"batch_id": t["batch_id"], "blob_path": f"{prefix}/batch_id={t['batch_id']}", "start_idx": t["start_idx"], "end_idx": t["end_idx"]}, trace_headers())
    return len(tasks)


def source(spark: SparkSession, path: str, files_per_trigger: int = 30, kafka: dict | None = None) -> DataFrame:
    """Slices from files, or from a Kafka topic whose values are books with their batch; messages keep the id of
    their trace."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest", "includeHeaders": "true"} | kafka).load()
        return raw.select(F.from_json(F.col("value").cast("string"), slice_schema()).alias("b"), trace_of(F.col("headers")).alias("trace_id")).select("b.*", "trace_id")
    return spark.readStream.schema(slice_schema()).option("maxFilesPerTrigger", files_per_trigger).json(path)


def embed_slices(some: DataFrame, embed: Callable[[Column], Column], dim: int) -> DataFrame:
    some = indexed(some, 1).withColumn("description", clean_description(F.col("description")))
    text = embedding_text(F.col("title"), F.coalesce("authors", F.array().cast("array<string>")), F.col("description"), F.coalesce("subjects", F.array().cast("array<string>")))
    return some.select("batch_id", F.col("row_idx").alias("start_idx"), "work_id", truncate(embed(text), dim).cast("array<float>").alias("embedding"))


def probe(spark: SparkSession, embed: Callable[[Column], Column]) -> None:
    """Try the model on a text before anything is read, so that a worker without one stops at once."""
    spark.range(1).select(embed(F.lit("probe")).alias("v")).first()


def note_error(spark: SparkSession, folder: str | None, batch_id: str, error: Exception, trace: str | None = None) -> None:
    """Diagnostics of a slice; what goes wrong here never hides the slice's own error."""
    if not folder:
        return
    try:
        at = datetime.datetime.now(datetime.UTC)
        body = {"batch_id": batch_id, "at": at.isoformat(), "trace_id": trace, "error": f"{type(error).__name__}: {error}"[:4000]}
        ObjectStore(spark, folder).put_bytes(f"{batch_id}-{at:%Y%m%dT%H%M%S%f}.json", json.dumps(body).encode())
    except Exception as e:  # noqa: BLE001
        print(f"no diagnostics of {batch_id}: {e}")


def write_slices(vectors: DataFrame, out: str, errors: str | None = None) -> list[str]:
    """Write a batch of slices; where that fails, each slice for itself, so that a bad one keeps no other back.
    Returns the slices that weren't written, which are noted under `errors`."""
    try:
        write_shards(vectors, out)
        return []
    except Exception:  # noqa: BLE001
        pass
    failed = []
    for (batch_id,) in vectors.sparkSession.createDataFrame(vectors.select("batch_id").distinct().collect(), "batch_id string").collect():
        try:
            write_shards(vectors.where(F.col("batch_id") == batch_id), out)
        except Exception as e:  # noqa: BLE001
            note_error(vectors.sparkSession, errors, batch_id, e)
            failed.append(batch_id)
    return failed


def start(spark: SparkSession, path: str, out: str, checkpoint: str, embed: Callable[[Column], Column], dim: int = 256, loop: bool = False, errors: str | None = None, interval: str = "10 seconds", **options) -> StreamingQuery:
    """Consumer: drains what is there and stops, or goes on with `loop`.

    The model is tried before anything is read. Slices are written batch by batch; one that fails is noted
    under `errors`, the others are done, and it comes again when it is put in again. Without an error
    folder a failure stops the stream, and the batch comes again. Replays replace the same slices.
    """
    probe(spark, embed)

    def sink(df: DataFrame, epoch: int) -> None:
        vectors = embed_slices(df, embed, dim)
        if errors:
            write_slices(vectors, out, errors)
        else:
            write_shards(vectors, out)

    writer = source(spark, path, **options).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if loop else writer.trigger(availableNow=True)).start()


def process(spark: SparkSession, store: ObjectStore, queue: FileQueue | KafkaQueue, message: Message, out: str, embed: Callable[[Column], Column], dim: int, errors: str | None = None) -> bool:
    """One task: its slice is read, embedded and written, and only then acknowledged. An empty slice is
    acknowledged; a failure is noted and leaves the task to come again."""
    task = message.body
    try:
        some = spark.read.schema(T.StructType([f for f in slice_schema().fields if f.name != "batch_id"])).json(f"{store.root}/{task['blob_path']}").withColumn("batch_id", F.lit(task["batch_id"]))
        vectors = embed_slices(some, embed, dim)
        if not vectors.isEmpty():
            write_shards(vectors, out)
    except Exception as e:  # noqa: BLE001
        note_error(spark, errors, task.get("batch_id", "unknown"), e, message.headers.get(TRACE))
        return False
    return queue.ack(message)


def _folder(store: ObjectStore, key: str) -> str:
    path, fs = store._at(key)
    return fs.makeQualified(path).toUri().getRawPath().rstrip("/")


def process_together(spark: SparkSession, store: ObjectStore, queue: FileQueue, messages: list[Message], out: str, embed: Callable[[Column], Column], dim: int, errors: str | None = None) -> int:
    """Several tasks in one job, each acknowledged when all are written. Where the job fails, each half is tried for
    itself, down to the task that fails. Returns the failures."""
    if len(messages) == 1:
        return int(not process(spark, store, queue, messages[0], out, embed, dim, errors))
    try:
        ids = {_folder(store, m.body["blob_path"]): m.body["batch_id"] for m in messages}
        if len(set(ids.values())) < len(messages):
            raise ValueError("two tasks share a slice or its id")
        schema = T.StructType([f for f in slice_schema().fields if f.name != "batch_id"])
        some = spark.read.schema(schema).json([f"{store.root}/{m.body['blob_path']}" for m in messages])
        folder = F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", ""), r"/[^/]*$", "")
        batch = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))[folder]
        some = some.withColumn("batch_id", F.coalesce(batch, F.raise_error(F.concat(F.lit("a file of no task: "), folder)).cast("string")))
        vectors = embed_slices(some, embed, dim)
        if not vectors.isEmpty():
            write_shards(vectors, out)
    except Exception:  # noqa: BLE001
        half = len(messages) // 2
        return sum(process_together(spark, store, queue, part, out, embed, dim, errors) for part in (messages[:half], messages[half:]))
    return sum(not queue.ack(m) for m in messages)


def work(spark: SparkSession, store: ObjectStore, queue: FileQueue | KafkaQueue, out: str, embed: Callable[[Column], Column], dim: int = 256, loop: bool = False, errors: str | None = None, idle: float = IDLE_SECONDS, wait: float = 0.5) -> int:
    """Task by task: one, or with `loop` till nothing came for `idle` seconds, where a file queue's tasks are done
    TASKS_AT_ONCE in a job. Returns the failures."""
    probe(spark, embed)
    failures, quiet = 0, time.monotonic()
    try:
        while True:
            got = queue.receive(TASKS_AT_ONCE if loop and isinstance(queue, FileQueue) else 1)
            if got:
                failures += process_together(spark, store, queue, got, out, embed, dim, errors)
                quiet = time.monotonic()
            if not loop or (not got and time.monotonic() - quiet >= idle):
                return failures
            if not got:
                time.sleep(min(wait, idle))
    finally:
        queue.close()
