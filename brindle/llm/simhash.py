"""SimHash near-duplicates by segment popcounts, a grid range-join and an exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, bounded_batches, by_cell, components, forest, free_name, run_starts

SEED = 42
LIMIT = 3
#: A fingerprint's embedding: the bit counts of its 32 segments of two bits. Neighbouring segments form
#: bands, more of them where there are more fingerprints: (fingerprints up to, bands).
SEGMENTS = 32
BANDS = ((1 << 27, 6), (1 << 31, 7), (1 << 63, 9))
BLOCK = 1024
#: The pipeline's stage has values of its own: texts are near from a Jaccard similarity of 4/5 of their
#: five-word shingles on. Fingerprints have WORDS * 64 bits, of which a pair of 4/5 has 15 % different (39 of 256, deviation 5.7)
#: and a random pair half; those of up to NEAR_LIMIT different bits link, and what links is checked exactly.
NEAR_WORDS = 5
NEAR = (4, 5)
WORDS, NEAR_LIMIT = 4, 72
#: Grid tables: the cell that a fingerprint meets has CELL others or up to 8/3 as many; tables go on until a pair of 4/5
#: shares a cell but in one of 1 / NEAR_MISS cases. ROUND tables are joined at a time, which bounds the disk.
CELL, NEAR_MISS, ROUND = 2048, 1e-4, 16
#: Members of a grid cell, and of a group that is checked with its shingles, that are held at once.
WIDE_BLOCK, NEAR_BLOCK = 4096, 128
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 63, (WORDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(0x0101010101010101)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text: words between ASCII white space, A-Z lower-cased,
    XXH64 (seed 42) of each run of `shingle` words. A bit is set if it is in over half the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    hashes = [h(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    padded = padded.reshape(-1, 255)
    out = 0
    for bit in range(8):  # one bit of each of the eight bytes at a time; 255 ones fit a byte
        sums = ((padded >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > n):
            out |= 1 << (8 * int(byte) + bit)
    return out


def fingerprints(docs: DataFrame, id_columns: list[str]) -> DataFrame:
    """`id_columns` and fp: the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select(*id_columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint_of(t) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns[:-1], pa.array(fp)], names=[*id_columns, "fp"])

    ids = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in id_columns)
    return narrow.mapInArrow(run, f"{ids}, fp long")


def segment_counts(fp: Column) -> Column:
    """The embedding, packed: each two-bit field holds the number of ones of its segment."""
    low, high = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(high).bitwiseAND(low), fp.bitwiseAND(high).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bands_for(n: int) -> list[tuple[int, int]]:
    """Bands of neighbouring segments, (from, to), for n fingerprints."""
    k = next(k for upto, k in BANDS if n <= upto)
    edges = [round(i * SEGMENTS / k) for i in range(k + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def grid_cells(fps: DataFrame, n: int) -> DataFrame:
    """(cell, id): each fingerprint in its cell of each grid table.

    The range join under Manhattan distance, in its exact form for a radius of LIMIT: a difference of
    1 in a segment's count moves a point in one band alone, so two points within the radius lie in
    the same cell of all but at most LIMIT bands. A table for each choice of the other bands, its
    cell being those bands' counts, holds every such pair, and no neighbouring cells need be visited.
    Hamming distance is never below the Manhattan distance, so no link is lost. More bands make longer
    keys and more tables, so cells stay small as the fingerprints grow.
    """
    counts = segment_counts(F.col("id"))
    bands = bands_for(n)
    keys = []
    for t, chosen in enumerate(combinations(bands, len(bands) - LIMIT)):
        mask = sum(((1 << (2 * (hi - lo))) - 1) << (2 * lo) for lo, hi in chosen)
        keys.append(F.xxhash64(counts.bitwiseAND(F.lit(_signed(mask))), F.lit(t)))
    return fps.select(F.explode(F.array(*keys)).alias("cell"), "id")


def _near(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of each group of blocks, as the edges of a forest."""
    cell, left, right = (table.column(i).to_numpy() for i in range(3))
    part, ids = table.column(3).to_numpy(), table.column(4).to_numpy()
    starts = run_starts([cell, left, right])
    from_a, to_b = [], []
    two = np.flatnonzero(starts[1:] - starts[:-1] == 2)  # most groups are pairs: all at once
    a, b = ids[starts[:-1][two]], ids[starts[:-1][two] + 1]
    near = _lower_bound(a.view(np.uint64), b.view(np.uint64)) <= LIMIT
    a, b = a[near], b[near]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= LIMIT
    from_a.append(a[near])
    to_b.append(b[near])
    for g in np.flatnonzero(starts[1:] - starts[:-1] > 2):
        s, e = starts[g], starts[g + 1]
        x = np.sort(ids[s:e].view(np.uint64)) if left[s] == right[s] else ids[s:e].view(np.uint64)
        if left[s] == right[s]:
            rows = cols = np.arange(len(x))
        else:
            rows, cols = np.flatnonzero(part[s:e] == left[s]), np.flatnonzero(part[s:e] == right[s])
        li, lj = [], []
        for k in range(0, len(rows), 256):
            some = x[rows[k : k + 256], None]
            low = _lower_bound(some, x[None, cols]) <= LIMIT
            i, j = np.nonzero(low)
            ok = np.bitwise_count(some[i, 0] ^ x[cols[j]]) <= LIMIT
            li.append(rows[k + i[ok]])
            lj.append(cols[j[ok]])
        root = forest(len(x), np.concatenate(li), np.concatenate(lj))
        linked = np.flatnonzero(root != np.arange(len(x)))
        from_a.append(x[linked].view(np.int64))
        to_b.append(x[root[linked]].view(np.int64))
    a, b = np.concatenate(from_a), np.concatenate(to_b)
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _lower_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segment counts, which is at most the Hamming distance."""
    return np.bitwise_count(_unary(a) ^ _unary(b))


def _unary(x: np.ndarray) -> np.ndarray:
    """The segment counts 0, 1, 2 in unary (00, 01, 11): the ones of a XOR are the sum of the differences."""
    m = np.uint64(0x5555555555555555)
    x = x - ((x >> np.uint64(1)) & m)
    return x | ((x >> np.uint64(1)) & m)


def fingerprint_groups(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(fp, root): the fingerprints that link with another one, by the least fp (signed) reachable.
    `rows(fp, ...)` is a written table; equal fingerprints are one."""
    fps = scratch.save(rows.select(F.col("fp").alias("id")).distinct())
    cells = scratch.save(grid_cells(fps, fps.count()))
    links = scratch.save(by_cell(scratch, cells, BLOCK, _near, "a long, b long"))
    scratch.drop(cells, fps)
    return components(scratch, links).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: doc_id, fingerprint (16 hexadecimal digits)
    and component_id, the smallest doc_id reachable over links of at most 3 differing bits.

    Null and blank texts have fingerprint zero and link like any other; repeated rows stay; a null
    doc_id gets its group's id, null where the group has no other. Empty input: empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, ["doc_id"]))
    roots = fingerprint_groups(scratch, rows)
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    each = scratch.save(each.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    least = scratch.save(each.groupBy("root").agg(F.min("low").alias("component_id")))
    named = scratch.save(each.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct XXH64 hashes, ascending, of a text's runs of NEAR_WORDS words, or of all its words
    where they are fewer; words as in `fingerprint_of`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    runs = max(1, len(words) - NEAR_WORDS + 1)
    return np.unique(np.array([h(b" ".join(words[i : i + NEAR_WORDS]), SEED) for i in range(runs)], np.uint64))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles in WORDS words: each shingle's hash is mixed anew for each word,
    and a bit is set if it is in over half of them."""
    counts = np.zeros((8, WORDS, 8), np.int64)
    for k in range(0, len(shingles), 255 * 256):
        h = _MULTIPLIERS * shingles[None, k : k + 255 * 256]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        padded = np.zeros((WORDS, -(-h.shape[1] // 255), 255), np.uint64)
        padded.reshape(WORDS, -1)[:, : h.shape[1]] = h
        for bit in range(8):  # as in `majority`
            sums = ((padded >> np.uint64(bit)) & _ONES).sum(axis=2, dtype=np.uint64)
            counts[bit] += sums.view(np.uint8).reshape(WORDS, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(np.moveaxis(counts, 0, 2) * 2 > len(shingles), axis=2, bitorder="little").reshape(-1).view(np.uint64)


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of NEAR or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * NEAR[1] >= (len(a) + len(b) - shared) * NEAR[0]


def _near_rows(docs: DataFrame, number: str) -> DataFrame:
    """doc_id, row (of the column `number`), fp (a hash of the set of shingles, 0 if empty), many (the size of the set)
    and w0, w1, ...: its wide fingerprint."""
    bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", F.col(number).alias("row"), "text")
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles_of(t) for t in b.column(2).to_pylist()]
            fp = [_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) if len(s) else 0 for s in sets]
            wide = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS).T.copy().view(np.int64)
            yield pa.record_batch([*b.columns[:2], pa.array(fp, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, wide)], names=["doc_id", "row", "fp", "many", *words])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, row long, fp long, many long, " + ", ".join(f"{w} long" for w in words))


def near_tables(n: int) -> list[np.ndarray]:
    """The segments whose counts are the cell, for each grid table of n wide fingerprints.

    Unlike at LIMIT no choice of bands holds every pair of the radius, so segments are drawn, as many as
    bring cells near CELL (two random counts are equal in 3/8 of cases), and tables follow until the chance
    that a pair of similarity NEAR shares no cell, over all numbers of different bits it may have, is NEAR_MISS.
    Few fingerprints are one cell.
    """
    segments = 0 if n <= WIDE_BLOCK else math.floor(math.log(n / CELL) / math.log(8 / 3))
    if not segments:
        return [np.zeros(0, int)]
    j, bits = NEAR[0] / NEAR[1], 64 * WORDS
    p = math.acos(2 * j / (1 + j)) / math.pi
    law = np.array([math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(bits + 1)])
    x = np.arange(bits + 1) / bits
    apart = 1 - ((1 - x) ** 2 + x * x / 2) ** segments
    tables = 1
    while law @ apart**tables > NEAR_MISS:
        tables += 1
    rng, out = np.random.default_rng(7), []
    while len(out) < tables:  # tables of one permutation share no segment
        order = rng.permutation(SEGMENTS * WORDS)
        out += [order[k : k + segments] for k in range(0, len(order) - segments + 1, segments)]
    return out[:tables]


def near_cells(known: DataFrame, tables: list[tuple[int, np.ndarray]]) -> DataFrame:
    """(cell, id, many, w0, w1, ...): each wide fingerprint in its cell of each of the numbered grid tables."""
    words = [f"w{k}" for k in range(WORDS)]
    counted = known.select("id", "many", *words, *[segment_counts(F.col(w)).alias(f"counts_{w}") for w in words])
    keys = []
    for t, chosen in tables:
        counts = []
        for k, w in enumerate(words):
            if mask := sum(3 << (2 * (int(c) % SEGMENTS)) for c in chosen if c // SEGMENTS == k):
                counts.append(F.col(f"counts_{w}").bitwiseAND(F.lit(_signed(mask))))
        keys.append(F.xxhash64(*counts, F.lit(t)))
    return counted.select(F.explode(F.array(*keys)).alias("cell"), "id", "many", *words)


def _wide(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Parts, ids, sizes and fingerprints (a row for each word) of rows for the comparison of cells."""
    words = np.array([t.column(6 + k).to_numpy() for k in range(WORDS)], np.int64).view(np.uint64)
    return *(t.column(k).to_numpy() for k in (3, 4, 5)), words


def _wide_links(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of NEAR_LIMIT between wide fingerprints of each group of blocks, as the edges of a forest. Sets whose
    sizes rule NEAR out aren't compared, nor those that are linked already."""
    cell, left, right = (t.column(i).to_numpy() for i in range(3))
    part, ids, size, words = _wide(t)
    starts = run_starts([cell, left, right])
    from_a, to_b = [], []
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        order = s + np.argsort(size[s:e], kind="stable")
        n, own, many = e - s, part[order], size[order]
        bits = words[:, order]
        unary = _unary(bits)
        same = left[s] == right[s]
        rows, cols = (np.arange(n),) * 2 if same else (np.flatnonzero(own == left[s]), np.flatnonzero(own == right[s]))
        most, others = many[cols], unary[:, cols]
        root = np.arange(n)
        for k in range(0, len(rows), 64):
            some = rows[k : k + 64]
            lo = np.searchsorted(most, -(-many[some[0]] * NEAR[0] // NEAR[1]))
            hi = k + len(some) if same else np.searchsorted(most, many[some[-1]] * NEAR[1] // NEAR[0], "right")
            if lo >= hi:
                continue
            low = np.bitwise_count(unary[0, some, None] ^ others[0, None, lo:hi])
            for w in range(1, WORDS):  # a sum of 256 wraps to 0: then the exact count decides
                low += np.bitwise_count(unary[w, some, None] ^ others[w, None, lo:hi])
            i, j = np.nonzero(low <= NEAR_LIMIT)
            i, j = some[i], cols[lo + j]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            near = np.bitwise_count(bits[:, i] ^ bits[:, j]).sum(axis=0, dtype=int) <= NEAR_LIMIT
            near &= np.minimum(many[i], many[j]) * NEAR[1] >= np.maximum(many[i], many[j]) * NEAR[0]
            if near.any():
                root = forest(n, np.append(np.arange(n), i[near]), np.append(root, j[near]))
        linked = np.flatnonzero(root != np.arange(n))
        from_a.append(ids[order[linked]])
        to_b.append(ids[order[root[linked]]])
    a, b = np.concatenate(from_a), np.concatenate(to_b)
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def similar_fingerprints(scratch: Scratch, known: DataFrame, n: int) -> DataFrame:
    """(cell, id, many, w0, w1, ...): the wide fingerprints that link with another one, by the least id reachable.
    The grid join of `fingerprint_groups`, for the n fingerprints of `known`, a written table."""
    tables = list(enumerate(near_tables(n)))
    found = [scratch.save(by_cell(scratch, near_cells(known, tables[k : k + ROUND]), WIDE_BLOCK, _wide_links, "a long, b long")) for k in range(0, len(tables), ROUND)]
    roots = scratch.save(components(scratch, reduce(DataFrame.unionByName, found)))
    scratch.drop(*found)
    cells = roots.select(F.col("root").alias("cell"), F.col("node").alias("id")).unionByName(roots.select(F.col("root").alias("cell"), F.col("root").alias("id")).distinct())
    out = scratch.save(cells.join(known.hint("merge"), "id").select("cell", "id", "many", *[f"w{k}" for k in range(WORDS)]), n)
    scratch.drop(roots)
    return out


def _alike(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each group of blocks: where it starts in `t`, and how far within NEAR_LIMIT the fingerprints are for
    each pair that the group is to compare (row above column), in rows ordered by id; 0 elsewhere."""
    cell, left, right = (t.column(i).to_numpy() for i in range(3))
    part, ids, size, words = _wide(t)
    starts = run_starts([cell, left, right])
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        order = s + np.argsort(ids[s:e], kind="stable")
        x, own, many = words[:, order], part[order], size[order]
        same = np.zeros((len(own), len(own)), np.uint8)
        for k in range(0, len(own), 64):
            apart = np.bitwise_count(x[:, k : k + 64, None] ^ x[:, None]).sum(axis=0, dtype=np.int16)
            few, lots = np.minimum(many[k : k + 64, None], many), np.maximum(many[k : k + 64, None], many)
            same[k : k + 64] = np.where(few * NEAR[1] >= lots * NEAR[0], np.maximum(NEAR_LIMIT + 1 - apart, 0), 0)
        same = np.tril(same, -1)
        if left[s] != right[s]:
            same[own[:, None] == own[None]] = 0
        yield s, order, same


def _likely(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each member with the earlier one whose fingerprint is most alike, the nearest of several."""
    ids, a, b = t.column(4).to_numpy(), [], []
    for _, order, same in _alike(t):
        best = same.shape[1] - 1 - same[:, ::-1].argmax(axis=1)
        rows = np.flatnonzero(same[np.arange(len(best)), best])
        a.append(ids[order[rows]])
        b.append(ids[order[best[rows]]])
    yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _checked(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between members of different roots, by their sets of shingles; what a link has joined is
    not compared again."""
    ids, roots, sets = t.column(4).to_numpy(), t.column(6 + WORDS).to_numpy(), t.column(7 + WORDS)
    for _, order, same in _alike(t):
        i, j = np.nonzero(same)
        _, group = np.unique(roots[order], return_inverse=True)
        some = group[i] != group[j]
        i, j = i[some], j[some]
        best = np.argsort(-same[i, j].astype(int), kind="stable")
        parts: dict[int, np.ndarray] = {}
        a, b = [], []
        for x, y in zip(i[best].tolist(), j[best].tolist(), strict=True):
            if group[x] == group[y]:
                continue
            for z in (x, y):
                if z not in parts:
                    parts[z] = np.frombuffer(sets[int(order[z])].as_py(), np.uint64)
            if is_near(parts[x], parts[y]):
                group[group == group[x]] = group[y]
                a.append(ids[order[x]])
                b.append(ids[order[y]])
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_groups(scratch: Scratch, mine: DataFrame, rows: DataFrame, number: str) -> DataFrame:
    """(fp, root) of the sets of shingles that link with another one, by links of NEAR or more.

    Wide fingerprints that link are found by segment counts, grid tables and the Hamming distance. The sets
    behind them are compared, all of them exactly and none that are linked already: first each with the
    one that looks most alike, then those that are in several groups still. A set of under NEAR[0]
    shingles is near no other.
    """
    words = [f"w{k}" for k in range(WORDS)]
    n = rows.count()
    sets_of = rows.where(F.col("many") >= NEAR[0]).groupBy("fp").agg(F.min("row").alias("first"), *[F.first(c).alias(c) for c in ("many", *words)])
    known = scratch.save(sets_of.withColumnRenamed("fp", "id"), 4 * n)
    placed = similar_fingerprints(scratch, known, known.count())
    wanted = scratch.save(known.select("id", "first").join(placed.select("id").hint("merge"), "id", "left_semi"), n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([shingles_of(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    texts = mine.select(F.col(number).alias("first"), "text").join(wanted.hint("merge"), "first")
    sets = scratch.save(texts.select("id", "text").mapInArrow(cut, "id long, shingles binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (2, 3))
            keep = [is_near(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = scratch.save(by_cell(scratch, placed, BLOCK, _likely, "a long, b long").distinct())
    held = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    links = scratch.save(held.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))
    known_roots = scratch.save(components(scratch, links))
    named = scratch.save(placed.join(known_roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select("cell", "id", "many", *words, F.coalesce("root", "id").alias("root")), 4 * n)
    mixed = named.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    open_cells = scratch.save(named.join(mixed.hint("merge"), "cell").join(sets.hint("merge"), "id").select("cell", "id", "many", *words, "root", "shingles"))
    more = scratch.save(by_cell(scratch, open_cells, NEAR_BLOCK, _checked, "a long, b long"))
    scratch.drop(known, placed, wanted, sets, pairs, links, named, open_cells)
    return components(scratch, known_roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)).select(F.col("node").alias("fp"), "root")


def _firsts(scratch: Scratch, docs: DataFrame, mine: DataFrame, rows: DataFrame, roots: DataFrame, number: str) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    n = rows.count()
    each = scratch.save(rows.groupBy("fp").agg(first), n)
    grouped = each.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "best")
    stay = scratch.save(grouped.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(number)), n)
    # a row for each document that stays: never a side to broadcast, whatever its size today
    return mine.join(stay.hint("merge"), number, "left_semi").select(*docs.columns)


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates by op6's links, with all its columns, whatever their names:
    the smallest doc_id (null last), the first such row. Cases as in `simhash_groups`."""
    scratch, number = Scratch(docs.sparkSession, "simhash-stage"), free_name(docs, "number")
    mine = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()))
    named = mine.select("doc_id", F.col(number).alias("row"), "text")
    rows = scratch.save(fingerprints(named, ["doc_id", "row"]))
    return _firsts(scratch, docs, mine, rows, fingerprint_groups(scratch, rows), number)


def drop_similar(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: as `drop_near`, with values of its own and an exact check. Near are texts whose sets
    of five-word shingles have a Jaccard similarity of 0.8 or more, and all without words (null, empty,
    blank); a group is what such links reach. Whole texts count, of any length."""
    scratch, number = Scratch(docs.sparkSession, "simhash-stage"), free_name(docs, "number")
    mine = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()))
    rows = scratch.save(_near_rows(mine, number))
    return _firsts(scratch, docs, mine, rows, near_groups(scratch, mine, rows, number), number)
