"""What the operators of this package share: tables in the shared scratch folder, connected
components, and the blocked comparison of the members of hash cells."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of documents handed to Python at once; whole texts can be long.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20
#: Narrow rows (some numbers) for each task that writes a table whose size is known.
NARROW_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one is made in local mode,
    and nothing else can run."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Long texts: hand them to Python some rows and megabytes at a time. Queries that run later in the
    session keep these bounds, unless their caller has set narrower ones."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if local := filesystem_path(path):
        shutil.rmtree(local, ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        _remove(spark, path)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors. A result may read
    them until the driver ends; then they go."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label
        self.root = f"{scratch_root(spark)}/brindle-{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(_remove_at_exit, spark, self.root)

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write and read again; a table of about so many narrow rows by as many tasks as they ask for."""
        if rows is not None and (parts := 1 + rows // NARROW_ROWS) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(parts)
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        self.spark._jvm.System.gc()  # else shuffle files that nothing needs stay until the driver happens to collect
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in frames:
            if path := self.paths.pop(id(df), None):
                _remove(self.spark, path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: what numbers of buckets and shards are chosen by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def free_name(docs: DataFrame, stem: str) -> str:
    """A column name that `docs` doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out of training. A null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def nonspace(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of `edges(a, b)` by alternating large-star and small-star steps.

    Returns (node, root), the root being the least node reachable. Each step reads a written
    table, so both sides of each join are plain shuffles that Spark can split where a hub is hot;
    minima are combined before the shuffle. Tables are written by as many tasks as the links ask for.
    No links: an empty result.
    """
    def stars(directed: Callable, neighbours: DataFrame) -> DataFrame:
        least = scratch.save(neighbours.groupBy("u").agg(F.min("v").alias("m")), seen[0])
        out = scratch.save(directed(neighbours, least).where("a <> b").distinct(), seen[0])
        scratch.drop(least)
        return out

    def large(n: DataFrame, least: DataFrame) -> DataFrame:
        return n.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))

    def small(n: DataFrame, least: DataFrame) -> DataFrame:
        near = n.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        return near.select("e.a", "e.b")

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(r)

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        grown = stars(large, both)
        shrunk = stars(small, grown.select(F.col("a").alias("u"), F.col("b").alias("v")))
        scratch.drop(now, grown)
        now, before, seen = shrunk, seen, mark(shrunk)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the links i-j."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        while not np.array_equal(root, up := root[root]):
            root = up
        left = root[i] != root[j]
        i, j = i[left], j[left]
    return root


def cell_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by its first `keys` columns into tables, each holding whole runs
    of equal keys; the last run of a batch waits for the next one."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if not now.num_rows:
            continue
        if rest is not None:
            now = pa.concat_tables([rest, now])
        last = [now.column(k)[now.num_rows - 1].as_py() for k in range(keys)]
        same = np.ones(now.num_rows, bool)
        for k in range(keys):
            same &= now.column(k).to_numpy() == last[k]
        cut = int(np.argmax(same))
        if cut:
            yield now.slice(0, cut)
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def run_starts(columns: list[np.ndarray]) -> np.ndarray:
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def by_cell(scratch: Scratch, cells: DataFrame, block: int, compare: Callable, schema: str, members: DataFrame | None = None) -> DataFrame:
    """Compare the members of each cell with each other, whatever its size.

    `cells(cell, id, ...)` is a written table. Cells of one row are left out. A cell of more than
    `block` rows is dealt into blocks of about that size, and each pair of blocks is a group of its
    own, so no task holds more than two blocks of a cell at once; all pairs are compared, none is
    emitted as such. `compare(table)` gets rows (cell, left, right, part, id, ...) that hold whole
    groups, sorted by the first three; part is the row's own block. `members(id, ...)`, a written table, adds
    its columns to the rows of cells that are compared, and to no others.
    """
    sizes = scratch.save(cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"))
    rest = [c for c in cells.columns if c != "cell"]
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    placed = cells.join(sizes, "cell").select("cell", *rest, parts.alias("parts"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit(77)), F.col("parts")).cast("int"))
    if members is not None:
        placed = placed.join(members.hint("merge"), "id")
        rest += [c for c in members.columns if c != "id"]
    dealt = placed.select("cell", *rest, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", *rest)
    dealt = dealt.repartition("cell", "left", "right").sortWithinPartitions("cell", "left", "right")

    def run(batches):
        for t in cell_runs(batches, 3):
            yield from compare(t)

    return dealt.mapInArrow(run, schema)


def filesystem_path(uri: str) -> str | None:
    """The path of a folder that is mounted as files, None for any other store."""
    if uri.startswith("file:"):
        return uri.removeprefix("file://").removeprefix("file:")
    return uri if uri.startswith("/") else None
