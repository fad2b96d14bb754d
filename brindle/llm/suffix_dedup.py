"""Removal of repeated byte strings by suffix arrays over shards.

Each string of WINDOW bytes falls to a group by its minimizer: the least hash of its strings of 32 bytes,
which depends on nothing else, so all copies of it meet. Neighbouring strings of a document with the
same minimizer travel as one stretch. Equal stretches are one before anything is sent; a stretch
whose minimizer occurs nowhere else holds no repeat. A group with too many bytes is dealt anew by the
minimizers of longer and longer strings, at last of WINDOW bytes. What is left is sorted by induction
(`induced_sort`), group by group, and strings that agree in WINDOW bytes are neighbours there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.induced_sort import suffix_order
from brindle.llm.shared import Scratch, bounded_batches, cell_runs, filesystem_path, run_starts, text_bytes

WINDOW = 100
#: Bytes of the strings whose hashes are minimized, level by level.
GRAMS = (32, 64, 92, WINDOW)
#: Text bytes whose stretches a task brings together before it sends them.
FLUSH_BYTES = 8 << 20
#: Text bytes that are hashed at once; a longer text is hashed whole.
CHUNK_BYTES = 1 << 20
#: Stretch bytes that are sorted at once, in whole minimizer groups.
SORT_BYTES = 1 << 20
#: A group whose different stretches have more bytes together goes to the next level: sorting takes some 60 bytes
#: for each. On the last level a stretch is a single string, and equal ones are one.
GROUP_BYTES = 4 << 20
#: Text bytes for each bucket of stretches: a task holds the records of one at once.
BUCKET_BYTES = 32 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of `gram` bytes, by doubling."""
    h, size, i = data.astype(np.uint64) + np.uint64(1), 1, 0
    while size * 2 <= gram:
        h = h[:-size] * _MIX[i] + h[size:]
        h ^= h >> np.uint64(29)
        size, i = size * 2, i + 1
    if size < gram:
        h = h[: len(h) - (gram - size)] * _MIX[i] + h[gram - size :]
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def minimizers(grams: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` hashes in a row."""
    m, size = grams, 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (span - size)], m[span - size :])


def held_twice(grams: np.ndarray, span: int, v: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether stretches (strings first to last) hold their minimizer v at two places, as all do that
    hold some string twice."""
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    out = last - first >= span
    for k in range(0, len(first), 8192):
        a, b, least = first[k : k + 8192], last[k : k + 8192], v[k : k + 8192, None]
        low = a + (view[a] == least).argmax(1)
        high = b + span - 1 - (view[b] == least)[:, ::-1].argmax(1)
        out[k : k + 8192] |= low != high
    return out


#: d and e are the two halves of a 128-bit digest (BLAKE2b) of the stretch's bytes.
RECORD = np.dtype([("v", "<u8"), ("d", "<u8"), ("e", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("at", "<i8"), ("len", "<i8"), ("twice", "?")])
NO_DOC = np.iinfo(np.int64).max


def stretches(texts: list[bytes], docs: np.ndarray, rows: np.ndarray, offsets: np.ndarray, level: int) -> np.ndarray:
    """The stretches of some texts, or parts of texts at `offsets`: minimizer, digest, document, row, place and
    length. On the last level each string is one."""
    long = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    if not long:
        return np.zeros(0, RECORD)
    joined = b"".join(texts[i] for i in long)
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(texts[i]) for i in long])
    starts = np.cumsum(sizes) - sizes
    span = WINDOW - GRAMS[level] + 1
    grams = gram_hashes(data, GRAMS[level])
    v = minimizers(grams, span)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes - WINDOW + 1, -1)
    valid = np.cumsum(inside, dtype=np.int8)[: len(v)] > 0
    new = np.append(True, v[1:] != v[:-1]) if span > 1 else np.ones(len(v), bool)
    new[starts[starts < len(v)]] = True
    new[1:] |= valid[1:] & ~valid[:-1]
    stop = np.append(new[1:] | ~valid[1:], True) & valid
    first, last = np.flatnonzero(new & valid), np.flatnonzero(stop)
    owner = np.searchsorted(starts, first, side="right") - 1
    out = np.zeros(len(first), RECORD)
    end = last + WINDOW
    which = np.array(long)[owner]
    out["v"], out["at"], out["len"] = v[first], first - starts[owner] + offsets[which], end - first
    out["twice"] = held_twice(grams, span, out["v"], first, last)
    whole = memoryview(joined)
    digests = b"".join([hashlib.blake2b(whole[s:e], digest_size=16).digest() for s, e in zip(first.tolist(), end.tolist(), strict=True)])
    out["d"], out["e"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    out["doc"], out["row"] = docs[which], rows[which]
    return out


def pack_records(r: np.ndarray) -> bytes:
    """Records column by column; places and lengths byte by byte, as most of their bytes are zero, and compressed."""
    small = np.concatenate([np.ascontiguousarray(r[c]).view(np.uint8).reshape(len(r), r.dtype[c].itemsize).T.ravel() for c in ("doc", "row", "at", "len", "twice")])
    return b"".join(np.ascontiguousarray(r[c]).tobytes() for c in ("v", "d", "e")) + zlib.compress(small.tobytes(), 1)


def unpack_records(blob: bytes, n: int) -> np.ndarray:
    out = np.empty(n, RECORD)
    for i, c in enumerate(("v", "d", "e")):
        out[c] = np.frombuffer(blob, "<u8", n, 8 * n * i)
    small = np.frombuffer(zlib.decompress(memoryview(blob)[24 * n :]), np.uint8)
    for i, c in enumerate(("doc", "row", "at", "len")):
        out[c] = np.ascontiguousarray(small[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view("<i8").ravel()
    out["twice"] = small[32 * n :].view("?")
    return out


def split_first(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records sorted by minimizer and stretch, which of them are the first of their stretch)."""
    r = r[np.lexsort((r["at"], r["row"], r["doc"], r["len"], r["e"], r["d"], r["v"]))]
    first = np.ones(len(r), bool)
    first[1:] = (r["v"][1:] != r["v"][:-1]) | (r["d"][1:] != r["d"][:-1]) | (r["e"][1:] != r["e"][:-1]) | (r["len"][1:] != r["len"][:-1])
    return r, first


PIECE = "row long, doc long, at long, content binary"


def whole_texts(docs: DataFrame) -> DataFrame:
    """(row, doc, at, content): a piece for each row's text in UTF-8, null as empty."""
    return docs.select("row", F.coalesce("doc", F.lit(NO_DOC)).alias("doc"), F.lit(0).cast("long").alias("at"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("content"))


FOUND = "kind int, v long, doc long, row long, at long, len long"


def _found(kind: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(r), kind, np.int32)), pa.array(r["v"].view(np.int64) if r["v"].flags.c_contiguous else np.ascontiguousarray(r["v"]).view(np.int64)), *(pa.array(np.ascontiguousarray(r[c])) for c in ("doc", "row", "at", "len"))], names=["kind", "v", "doc", "row", "at", "len"])


REMOVED, SORT, DEAL = 0, 1, 2


def find_stretches(pieces: DataFrame, buckets: int, level: int = 0) -> DataFrame:
    """Stretches of `pieces(row, doc, at, content)`: those to remove as copies of an earlier one, those to sort,
    and those of groups that are too large for that and are dealt anew (DEAL)."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            r, first = split_first(np.concatenate(held))
            blobs = [(int(x["row"][0]) % buckets, REMOVED, len(x), pack_records(x)) for x in [r[~first]] if len(x)]
            r = r[first]
            bucket = (r["v"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            r, bucket = r[order], bucket[order]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(r)) if len(r) else []
            blobs += [(int(bucket[s]), SORT, int(e - s), pack_records(r[s:e])) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            b, k, n, x = zip(*blobs, strict=True) if blobs else ((), (), (), ())
            return pa.record_batch([*(pa.array(c, pa.int32()) for c in (b, k, n)), pa.array(x, pa.binary())], names=["bucket", "kind", "n", "blob"])

        for b in batches:
            ids, docs, ats = (b.column(i).to_numpy() for i in range(3))
            texts = b.column(3).to_pylist()
            k = 0
            while k < len(texts):  # some texts at a time; a text is never cut
                e, n = k, 0
                while e < len(texts) and (e == k or n + len(texts[e]) <= CHUNK_BYTES):
                    n += len(texts[e])
                    e += 1
                held.append(stretches(texts[k:e], docs[k:e], ids[k:e], ats[k:e], level))
                size += n
                k = e
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cell_runs(batches, 1):
            bucket, kinds, counts, blobs = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist(), t.column(3).to_pylist()
            cuts = run_starts([bucket])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                done = [unpack_records(blobs[i], counts[i]) for i in range(s, e) if kinds[i] == REMOVED]
                some = [unpack_records(blobs[i], counts[i]) for i in range(s, e) if kinds[i] != REMOVED]
                for r in done:
                    yield _found(REMOVED, r)
                if not some:
                    continue
                r, first = split_first(np.concatenate(some))
                if not first.all():
                    yield _found(REMOVED, r[~first])
                r = r[first]
                starts = np.flatnonzero(np.append(True, r["v"][1:] != r["v"][:-1]))
                count = np.repeat(np.diff(np.append(starts, len(r))), np.diff(np.append(starts, len(r))))
                size = np.repeat(np.add.reduceat(r["len"], starts), np.diff(np.append(starts, len(r))))
                alone = (count == 1) & ~r["twice"]
                large = (size > GROUP_BYTES) & (level < len(GRAMS) - 1)
                for kind, pick in ((SORT, ~alone & ~large), (DEAL, ~alone & large)):
                    if pick.any():
                        yield _found(kind, r[pick])

    sent = pieces.mapInArrow(send, "bucket int, kind int, n int, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND)


def cut_stretches(rows: DataFrame, found: DataFrame, kind: int) -> DataFrame:
    """(v, row, doc, at, content): the bytes of the stretches of a kind. `rows(row, doc, at, content)` are the
    whole texts."""
    wanted = found.where(F.col("kind") == kind).groupBy("row").agg(F.collect_list(F.struct("v", "at", "len")).alias("want"))
    joined = rows.join(wanted.hint("merge"), "row").select("row", "doc", "content", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, flat = b.column(2)[i].as_py(), b.column(3).slice(i, 1).flatten()
                v, at, size = (flat.field(k).to_numpy() for k in range(3))
                parts = [text[s : s + n] for s, n in zip(at.tolist(), size.tolist(), strict=True)]
                cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_BYTES, prepend=0)).tolist()
                for s, e in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                    if e > s:
                        yield pa.record_batch([pa.array(v[s:e]), *(pa.array(np.full(e - s, b.column(k)[i].as_py())) for k in (0, 1)), pa.array(at[s:e]), pa.array(parts[s:e], pa.binary())], names=["v", "row", "doc", "at", "content"])

    return joined.mapInArrow(run, f"v long, {PIECE}")


def repeats_in(contents: list[bytes], depth: int = WINDOW, folder: str | None = None) -> list[list[tuple[int, int]]]:
    """For each text, the runs (start, end) of places where a string of `depth` bytes begins that also
    begins earlier: in a text before it in the list, or before in the same one."""
    sizes = np.array([len(c) for c in contents])
    t = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).copy()
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    # bytes shift up by one, so that no byte equals the separator; UTF-8 has no 0xFE and no 0xFF
    t += 1
    t[ends] = 0
    order, lcp = suffix_order(t, depth, folder=folder)
    group = np.flatnonzero(lcp < depth)
    low = np.minimum.reduceat(order, group)
    early = np.repeat(low, np.diff(np.append(group, len(order))))
    owner = np.searchsorted(starts, order, side="right") - 1
    gone = np.zeros(len(t) + 1, bool)
    gone[order[(order != early) & (ends[owner] - order >= depth)]] = True
    edge = np.flatnonzero(np.diff(np.append(False, gone).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        k = int(np.searchsorted(starts, s, side="right") - 1)
        out[k].append((int(s - starts[k]), int(e - starts[k])))
    return out


SPAN = "row long, start long, stop long"


def sort_shards(cut: DataFrame, folder: str | None) -> DataFrame:
    """(row, start, stop) of bytes that repeat, from the suffix arrays of the stretches of each group."""
    def solve(v: list[int], doc: list[int], row: list[int], at: list[int], content: list[bytes]) -> pa.RecordBatch:
        order = sorted(range(len(v)), key=lambda i: (doc[i], row[i], at[i]))
        spans = repeats_in([content[i] for i in order], folder=folder)
        out = [(row[i], at[i] + s, at[i] + e - 1 + WINDOW) for i, some in zip(order, spans, strict=True) for s, e in some]
        r, s, e = zip(*out, strict=True) if out else ((), (), ())
        return pa.record_batch([pa.array(x, pa.int64()) for x in (r, s, e)], names=["row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size = 0
        for t in cell_runs(batches, 1):
            cols = [t.column(i).to_pylist() for i in range(5)]
            for s, e in (lambda c: zip(c[:-1], c[1:], strict=True))(run_starts([np.array(cols[0])])):
                for h, c in zip(held, cols, strict=True):
                    h += c[s:e]
                size += sum(len(x) + 1 for x in cols[4][s:e])
                if size >= SORT_BYTES:
                    yield solve(*held)
                    held, size = [[], [], [], [], []], 0
        if held[0]:
            yield solve(*held)

    return cut.select("v", "doc", "row", "at", "content").repartition("v").sortWithinPartitions("v").mapInArrow(run, SPAN)


def remove_repeated_bytes(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    Texts are read as UTF-8 bytes, null as empty; matches never cross documents. Each byte goes that a
    string of 100 bytes covers which also begins earlier: in a document of smaller doc_id (null last;
    equal ids by row), or before in the same one. A text of any length is one text; repeated rows lose
    all but the first's bytes. Other columns aren't read. `docs` is read once and its rows are kept
    with their numbers, which a second scan may deal otherwise. Empty input: empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "suffix")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc"), "text"))
    texts = whole_texts(rows)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // BUCKET_BYTES))
    pieces, spans = texts, None
    for level in range(len(GRAMS)):
        found = scratch.save(find_stretches(pieces, buckets, level))
        plain = found.where(f"kind = {REMOVED}").select("row", F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("stop"))
        cut = scratch.save(cut_stretches(texts, found, SORT))
        more = plain.unionByName(sort_shards(cut, filesystem_path(scratch.root)))
        spans = more if spans is None else spans.unionByName(more)
        if found.where(f"kind = {DEAL}").isEmpty():
            break
        pieces = scratch.save(cut_stretches(texts, found, DEAL).drop("v"))
    spans = scratch.save(spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    joined = rows.join(spans.hint("merge"), "row", "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, some in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, at, n_spans, removed = [], 0, 0, 0
                if some:
                    merged: list[list[int]] = []
                    for s, e in sorted((x["start"], x["stop"]) for x in some):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        kept.append(data[at:s])
                        removed += e - s
                        at = e
                    n_spans = len(merged)
                kept.append(data[at:])
                out.append((len(data), removed, n_spans, b"".join(kept)))
            n, r, s, k = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
