"""Exact de-duplication over a cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, cell_runs, free_name, nonspace, run_starts

SLOTS = 4
MAX_KICKS = 200
KEY = 32
#: Live digests of a map-side index; beyond, the oldest quarter is sent on and deleted.
LIVE = 200_000
#: Rows for each shard of digests; a shard's index holds at most that many keys, about.
SHARD_ROWS = 500_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints in front of buckets that hold the full keys.

    Each bucket has SLOTS places; a place holds a fingerprint (0 for none), a key of KEY bytes (a digest)
    and a number that stands for its value. `get`, `insert` and `delete` look at the fingerprints of a
    key's two buckets; only where one agrees is the place's key read and compared. When an insertion
    finds no free place within MAX_KICKS moves, the buckets double and are filled anew from the stored
    keys, so no key is lost and none is reported wrongly.
    """

    def __init__(self, capacity: int = 1024):
        self.seed, self.false_hits, self.resizes, self.count = 0x9E3779B1, 0, 0, 0
        self.buckets = 1
        while self.buckets * SLOTS < capacity:
            self.buckets *= 2
        self._clear()

    def _clear(self) -> None:
        n = SLOTS * self.buckets
        self.marks, self.keys, self.values = array("H", bytes(2 * n)), bytearray(KEY * n), array("q", bytes(8 * n))

    def __len__(self) -> int:
        return self.count

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[8:14], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _slot(self, key: bytes) -> int:
        """The place of a live key, or -1."""
        mark, a, b = self._place(key)
        marks = self.marks
        for bucket in (a, b) if a != b else (a,):
            at = bucket * SLOTS
            if mark in marks[at : at + SLOTS]:  # a hit of the filter: now the bucket's content is read
                for i in range(at, at + SLOTS):
                    if marks[i] == mark:
                        if self.keys[KEY * i : KEY * i + KEY] == key:
                            return i
                        self.false_hits += 1
        return -1

    def may_contain(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        return mark in self.marks[a * SLOTS : a * SLOTS + SLOTS] or mark in self.marks[b * SLOTS : b * SLOTS + SLOTS]

    def get(self, key: bytes, default: int | None = None) -> int | None:
        """The value of a live key."""
        i = self._slot(key)
        return default if i < 0 else self.values[i]

    def insert(self, key: bytes, value: int = 0) -> None:
        """Add a key, or replace the value of a live one."""
        i = self._slot(key)
        if i >= 0:
            self.values[i] = value
            return
        if self.count >= 0.9 * SLOTS * self.buckets:
            self._resize()
        self.count += 1
        while (left := self._add(key, value)) is not None:
            key, value = left
            self._resize()

    def delete(self, key: bytes) -> bool:
        """Take a live key out; False if it isn't there. Only a verified key frees a place."""
        i = self._slot(key)
        if i < 0:
            return False
        self.marks[i] = 0
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, int]]:
        for i, mark in enumerate(self.marks):
            if mark:
                yield bytes(self.keys[KEY * i : KEY * i + KEY]), self.values[i]

    def _put(self, i: int, mark: int, key: bytes, value: int) -> None:
        self.marks[i], self.keys[KEY * i : KEY * i + KEY], self.values[i] = mark, key, value

    def _free(self, bucket: int) -> int:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.marks[i]:
                return i
        return -1

    def _add(self, key: bytes, value: int) -> tuple[bytes, int] | None:
        """Place a new key; what no place was found for after MAX_KICKS moves comes back."""
        mark, a, b = self._place(key)
        for bucket in (a, b):
            if (i := self._free(bucket)) >= 0:
                self._put(i, mark, key, value)
                return None
        at = a
        for _ in range(MAX_KICKS):
            self.seed = (self.seed * 1103515245 + 12345) & 0x7FFFFFFF
            i = at * SLOTS + (self.seed >> 8) % SLOTS
            old = self.marks[i], bytes(self.keys[KEY * i : KEY * i + KEY]), self.values[i]
            self._put(i, mark, key, value)
            mark, key, value = old
            at = self._other(at, mark)
            if (i := self._free(at)) >= 0:
                self._put(i, mark, key, value)
                return None
        return key, value

    def _resize(self) -> None:
        stored = list(self.items())
        while True:
            self.buckets *= 2
            self.resizes += 1
            self._clear()
            if all(self._add(k, v) is None for k, v in stored):
                return


class Keepers:
    """The best row of each live digest: an index over numbered rows (n, len, doc, rid)."""

    def __init__(self) -> None:
        self.index, self.rows, self.next = CuckooIndex(), {}, 0

    def add(self, sha: bytes, n: int, length: int, doc: int | None, rid: int) -> None:
        at = self.index.get(sha)
        if at is None:
            self.index.insert(sha, self.next)
            self.rows[self.next] = (sha, n, length, doc, rid)
            self.next += 1
            return
        _, before, *best = self.rows[at]
        best = min(best, (length, doc, rid), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        self.rows[at] = (sha, before + n, *best)

    def take(self, count: int | None = None) -> pa.RecordBatch:
        """The `count` oldest digests (all without a count), which are deleted from the index."""
        numbers = list(islice(self.rows, count))
        out = [self.rows.pop(i) for i in numbers]
        if count is not None:
            for row in out:
                self.index.delete(row[0])
        return pa.record_batch([pa.array([r[0] for r in out], pa.binary()), *(pa.array([r[i] for r in out], pa.int64()) for i in range(1, 5))], names=["sha", "n", "len", "doc", "rid"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own rows (sha, n, len, doc, rid), merged by digest while it is live."""
    live = Keepers()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            live.add(*row)
            if len(live.index) >= LIVE:
                yield live.take(LIVE // 4)
    if len(live.index):
        yield live.take()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, sha, n, len, doc, rid) in order of shards: an index for each, which ends with it."""
    live, now = Keepers(), None
    for t in cell_runs(batches, 1):
        shard = t.column(0).to_numpy()
        cuts = run_starts([shard])
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if now is not None and shard[s] != now and len(live.index):
                yield live.take()
                live = Keepers()
            now = shard[s]
            for row in zip(*(c.to_pylist() for c in t.slice(s, e - s).columns[1:]), strict=True):
                live.add(*row)
    if len(live.index):
        yield live.take()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, len, sha): the digest of the text without ASCII white space, by JVM functions."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"), F.unhex(F.sha2(nonspace(F.col("text")).cast("binary"), 256)).alias("sha"))


def keepers(rows: DataFrame, n_rows: int) -> DataFrame:
    """One row for each digest: (sha, group_size, keep_id, keep_rid).

    Each input partition merges its own rows in an index of a bounded number of live digests before the
    shuffle, so a digest that a third of all rows share reaches its shard as a row or few from each
    task. Shards are as many as the rows ask for, so a shard's index is bounded too; Spark sorts the
    rows by shard, and spills.
    """
    schema = "sha binary, n long, len long, doc long, rid long"
    local = rows.select("sha", F.lit(1).cast("long").alias("n"), "len", F.col("doc_id").cast("long").alias("doc"), "rid").mapInArrow(_local, schema)
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SHARD_ROWS))
    dealt = local.select(F.pmod(F.xxhash64("sha"), F.lit(shards)).alias("shard"), "*")
    shard = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, schema)
    return shard.select("sha", F.col("n").alias("group_size"), F.col("doc").alias("keep_id"), F.col("rid").alias("keep_rid"))


def exact_dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, texts of any length
    are read whole. Of equal texts the row with the most code points stays, then the smallest doc_id
    (null last); of wholly equal rows exactly one is kept. Other columns aren't read. Empty input:
    empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    rows = scratch.save(digests(docs))
    best = scratch.save(keepers(rows, rows.count()))
    return rows.join(best, "sha").select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names; cases as in
    `exact_dedup`."""
    scratch = Scratch(docs.sparkSession, "exact-stage")
    number = free_name(docs, "row")
    mine = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()))
    keyed = mine.select("doc_id", F.col(number).alias("rid"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"), F.unhex(F.sha2(nonspace(F.col("text")).cast("binary"), 256)).alias("sha"))
    stay = scratch.save(keepers(keyed, mine.count()).select(F.col("keep_rid").alias(number)))
    # a row for each document that stays: never a side to broadcast, whatever its size today
    return mine.join(stay.hint("merge"), number, "left_semi").select(*docs.columns)
