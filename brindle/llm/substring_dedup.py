"""Removal of repeated lines or paragraphs by hashing normalised units."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, bounded_batches, cell_runs, run_starts, text_bytes

#: Units tile a text: a unit takes the separator after it along. A paragraph ends at blank lines, a line at
#: a line feed, a sentence (a line that is broken after each of its sentences) also at white space
#: that follows an end mark.
UNITS = {
    "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t]*\n))*(?:\n(?:[ \t]*\n)+|\n?\Z)"),
    "line": re.compile(r"[^\n]*(?:\n|\Z)"),
    "sentence": re.compile(r"[^.!?…\n]*(?:[.!?…]+[^.!?…\n \t][^.!?…\n]*)*[.!?…]*(?:[ \t]+|\n|\Z)"),
}
#: A passage of over 50 words that stands anywhere in two texts loses its first and last unit, which are cut
#: differently; about half its words remain in whole units.
LEAST_WORDS = 25
#: Text bytes whose units a task brings together before it sends them, and for each bucket of digests.
FLUSH_BYTES = 16 << 20
BUCKET_BYTES = 64 << 20
MARK = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("unit", "<i8")])
NO_DOC = np.iinfo(np.int64).max


def normalise(unit: str) -> list[bytes]:
    """The lower-case words between ASCII white space; joined by spaces they are what is hashed."""
    return unit.lower().encode("utf-8", "surrogatepass").split()


def units_of(text: str, kind: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each unit that isn't blank, in code points, separators included."""
    for m in UNITS[kind].finditer(text):
        if words := normalise(m[0]):
            yield m.start(), m.end(), words


def _marks(text: str | None, doc: int, row: int, kind: str) -> np.ndarray:
    digests = b"".join(hashlib.blake2b(b" ".join(words), digest_size=16).digest() for _, _, words in units_of(text or "", kind))
    out = np.zeros(len(digests) // 16, MARK)
    both = np.frombuffer(digests, "<u8").reshape(-1, 2)
    out["a"], out["b"], out["doc"], out["row"], out["unit"] = both[:, 0], both[:, 1], doc, row, np.arange(len(out))
    return out


def _split_first(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks by digest and rank, which of them are the first of their digest)."""
    r = r[np.lexsort((r["unit"], r["row"], r["doc"], r["b"], r["a"]))]
    first = np.ones(len(r), bool)
    first[1:] = (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])
    return r, first


def repeated_units(rows: DataFrame, kind: str, buckets: int) -> DataFrame:
    """(row, unit) of all units that an earlier one equals. `rows(row, doc, text)` is a written table.

    Each task ranks the units of some megabytes of text and sends on only the first of equal ones, so a
    line that a third of all texts hold reaches its bucket as one mark from each such lot.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            r, first = _split_first(np.concatenate(held))
            again, r = r[~first], r[first]
            bucket = (r["a"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            r, bucket = r[order], bucket[order]
            cuts = run_starts([bucket]) if len(r) else np.zeros(1, np.int64)
            out = [(int(bucket[s]), False, r[s:e].tobytes()) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(again):
                out.append((int(again["row"][0] % buckets), True, again.tobytes()))
            b, k, x = zip(*out, strict=True) if out else ((), (), ())
            return pa.record_batch([pa.array(b, pa.int64()), pa.array(k, pa.bool_()), pa.array(x, pa.binary())], names=["bucket", "known", "blob"])

        for batch in batches:
            docs = batch.column(1).fill_null(NO_DOC).to_pylist()
            for row, doc, text in zip(batch.column(0).to_pylist(), docs, batch.column(2).to_pylist(), strict=True):
                held.append(_marks(text, doc, row, kind))
                size += len(text or "")
                if size >= FLUSH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def found(r: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(r[c])) for c in ("row", "unit")], names=["row", "unit"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in cell_runs(batches, 1):
            bucket, known, blobs = t.column(0).to_numpy(), t.column(1).to_pylist(), t.column(2).to_pylist()
            cuts = run_starts([bucket])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                some = [np.frombuffer(blobs[i], MARK) for i in range(s, e) if not known[i]]
                for i in range(s, e):
                    if known[i]:
                        yield found(np.frombuffer(blobs[i], MARK))
                if some:
                    r, first = _split_first(np.concatenate(some))
                    yield found(r[~first])

    sent = rows.mapInArrow(send, "bucket long, known boolean, blob binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "row long, unit long")


def _cut(text: str, again: list[int], kind: str, least: int) -> tuple[int, list[tuple[int, int]]]:
    """(units, those that go): repeated units in a row of at least so many words together."""
    repeated, n, out = set(again), 0, []
    run: list[tuple[int, int]] = []
    words = 0
    for n, (start, end, some) in enumerate(units_of(text, kind), 1):
        if n - 1 in repeated:
            run.append((start, end))
            words += len(some)
            continue
        if run and words >= least:
            out += run
        run, words = [], 0
    return n, out + run if words >= least else out


def remove_repeats(docs: DataFrame, kind: str = "line", least_words: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: doc_id, n_units, n_removed, removed_chars, spans
    (start and end of each removed unit with its separator, in the original text, in code points, in
    order) and kept_text.

    Units are equal if their normalised forms are. Of equal units of all documents the earliest stays:
    smallest doc_id (null last; equal ids by row), place. The others are repeated. Repeated units that
    follow each other go if they have `least_words` words together; blank units aren't counted, stay
    and don't part a run. A null text is empty and has no unit. Texts of any length are read whole;
    repeated rows repeat all their units. Only doc_id and text are read, so other columns and their
    names don't matter. Empty input: empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = scratch or Scratch(spark, "lines")
    mine = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-text_bytes(mine) // BUCKET_BYTES))
    again = repeated_units(mine.select("row", F.col("doc_id").cast("long"), "text"), kind, buckets)
    spans = scratch.save(again.groupBy("row").agg(F.collect_list("unit").alias("cut")))
    joined = mine.join(spans.hint("merge"), "row", "left").select("doc_id", "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_units, chars, spans, kept = [], [], [], []
            for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or ""
                n, gone = _cut(text, cut or [], kind, least_words)
                out, at = [], 0
                for start, end in gone:
                    out.append(text[at:start])
                    at = end
                out.append(text[at:])
                n_units.append(n)
                chars.append(sum(e - s for s, e in gone))
                spans.append([{"start": s, "end": e} for s, e in gone])
                kept.append("".join(out))
            yield pa.record_batch([b.column(0), pa.array(n_units, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(chars, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())], names=["doc_id", "n_units", "n_removed", "removed_chars", "spans", "kept_text"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {id_type}, n_units long, n_removed long, removed_chars long, spans array<struct<start:int,end:int>>, kept_text string")
