"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, by_cell, components, forest, run_starts

COSINE = 0.95
#: Of pairs just at the threshold, this part at least is expected to share a bucket.
RECALL = 0.98
#: Width of a quantised projection, in units of the distance of unit vectors.
WIDTH = 2.0
SEED = 23
BLOCK = 1024
#: Random vectors that a bucket may hold beside each vector, on average, by the choice of hash length: few, so
#: that most vectors are alone in most buckets and aren't sent there.
CANDIDATES = 0.5


def collide(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection agrees at a Euclidean distance."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))


def parameters(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections in a hash, tables): buckets keep about CANDIDATES unrelated vectors however many
    rows there are, and the tables are as many as the recall at the threshold needs."""
    near, far = collide(math.sqrt(2 - 2 * cosine)), collide(math.sqrt(2))
    length = max(4, math.ceil(math.log(max(rows, 2) / CANDIDATES) / -math.log(far)))
    return length, max(2, math.ceil(math.log(1 - recall) / math.log(1 - near**length)))


def projections(dim: int, length: int, tables: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim, tables * length)), rng.uniform(0, WIDTH, tables * length)


def classes(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, vec, n, low): a row for each distinct valid vector, with its copies counted and their least
    vec_id. Copies are combined before the shuffle. `id` numbers the rows of a written table."""
    some = vectors.where(is_valid()).select("vec_id", as_key().alias("vec"))
    grouped = some.groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    return scratch.save(grouped.select(F.monotonically_increasing_id().alias("id"), "vec", "n", "low"))


def as_key() -> Column:
    """The vector in double precision, -0 and 0 being one."""
    return F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))


def is_valid() -> Column:
    key = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(key, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(key, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


class Hasher:
    """The bucket of a unit vector in each table: quantised random projections, mixed into a long."""

    def __init__(self, length: int, tables: int):
        self.length, self.tables = length, tables
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.weights = np.random.default_rng(SEED + 1).integers(1, 1 << 62, size=length, dtype=np.int64) | 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d not in self.made:
            self.made[d] = projections(d, self.length, self.tables)
        a, shift = self.made[d]
        q = np.floor((x @ a + shift) / WIDTH).astype(np.int64).reshape(len(x), self.tables, self.length)
        with np.errstate(over="ignore"):
            h = (q * self.weights).sum(2) * np.int64(0x9E3779B97F4A7C1 | 1) + np.int64(d) + np.arange(self.tables) * np.int64(0x5851F42D4C957F2D)
        return h ^ (h.view(np.uint64) >> np.uint64(29)).view(np.int64)


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(reps: DataFrame, hasher: Hasher) -> DataFrame:
    """(cell, id): ids alone go into the tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                ids, vecs = some.column(0).to_numpy(), some.column(1)
                sizes = pc.list_value_length(vecs).to_numpy()
                for d in np.unique(sizes):
                    mine = np.flatnonzero(sizes == d)
                    h = hasher(unit_rows(vecs.take(pa.array(mine)).flatten().to_numpy(), int(d)))
                    yield pa.record_batch([pa.array(h.ravel()), pa.array(np.repeat(ids[mine], hasher.tables))], names=["cell", "id"])

    return reps.select("id", "vec").mapInArrow(run, "cell long, id long")


def _compare(cosine: float, hasher: Hasher):
    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """For each group: the copies that each vector links with, as counts, and a spanning forest.
        A pair counts in the first table whose bucket holds both, and in no other one."""
        names = t.column_names
        cell, left, right, part, ids, n = (t.column(names.index(c)).to_numpy() for c in ("cell", "left", "right", "part", "id", "n"))
        starts = run_starts([cell, left, right])
        vecs = t.column("vec").combine_chunks()
        ends, flat = vecs.offsets.to_numpy(), vecs.values.to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            sizes = np.diff(ends[s : e + 1])
            if e - s < 2 or (sizes != sizes[0]).any():
                continue  # a bucket holds vectors of one length; a clash of the mixed hash links none
            x = unit_rows(flat[ends[s] : ends[e]], int(sizes[0]))
            if left[s] == right[s]:
                rows = cols = np.arange(e - s)
            else:
                rows, cols = np.flatnonzero(part[s:e] == left[s]), np.flatnonzero(part[s:e] == right[s])
            found = []
            for k in range(0, len(rows), 256):
                some = rows[k : k + 256]
                i, j = np.nonzero(x[some] @ x[cols].T >= cosine)
                i, j = some[i], cols[j]
                if left[s] == right[s]:
                    i, j = i[i < j], j[i < j]
                found.append((i, j))
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(i):
                continue
            keys = hasher(x)
            counts, weight, new = np.zeros(e - s, np.int64), n[s:e], np.zeros(len(i), bool)
            for k in range(0, len(i), 4096):
                same = keys[i[k : k + 4096]] == keys[j[k : k + 4096]]
                new[k : k + 4096] = keys[i[k : k + 4096], same.argmax(1)] == cell[s]
            i, j = i[new], j[new]
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            root = forest(e - s, i, j)
            hit = np.flatnonzero(counts)
            out[0].append(ids[s:e][hit])
            out[1].append(counts[hit])
            out[2].append(ids[s:e][root[hit]])
        if out[0]:
            yield pa.record_batch([pa.array(np.concatenate(o)) for o in out], names=["id", "links", "root"])

    return compare


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of `vectors(vec_id, embedding, ...)`: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are
    their own component; vectors of different lengths never link. Copies of a vector are one class: its
    members link with each other and share all their links. Repeated vec_ids stay separate rows that
    count each other. No link below the threshold is ever made; those above are found with the stated
    recall, as each table buckets by quantised random projections. Empty input: empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "embed")
    reps = classes(vectors, scratch)
    hasher = Hasher(*parameters(reps.count(), cosine, recall))
    cells = scratch.save(_cells(reps, hasher))
    found = scratch.save(by_cell(scratch, cells, BLOCK, _compare(cosine, hasher), "id long, links long, root long", reps.select("id", "vec", "n")))
    scratch.drop(cells)
    counts = scratch.save(found.groupBy("id").agg(F.sum("links").alias("links")))
    roots = components(scratch, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = scratch.save(reps.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").select("vec", "n", "low", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = scratch.save(named.groupBy("root").agg(F.min("low").alias("component_id")))
    known = scratch.save(named.join(least, "root").select("vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"))
    linked = vectors.where(is_valid()).select("vec_id", as_key().alias("vec")).join(known, "vec").select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = vectors.where(~is_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
