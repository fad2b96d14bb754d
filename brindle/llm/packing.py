"""Best-fit packing of token pieces into sequences by a linear grouping scheme."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, bounded_batches

CAPACITY = 4096
END_ID = 1
#: Pieces are packed in shards of about this many sequences, dealt by a hash.
SHARD_SEQUENCES = 1024
#: Sequences filled to less than this meet those of the other shards and are packed once more.
LOOSE = CAPACITY * 7 // 8
#: Pieces over this part of the capacity are large.
LARGE = CAPACITY // 8
GROUPS = 48
#: The choice of configurations ends when it is proven to be so close to the best.
GAP = 2e-3
MAX_ROUNDS = 300
#: Token step of the knapsack that finds configurations: grouped lengths are rounded up to it.
STEP = 4
#: Fills below which sequences are opened again, each tried on the packing before.
REOPEN = (0.5, 0.8, 0.9, 0.95, 0.98)
#: Words whose ids a worker remembers at most, white-space words and letter runs each.
REMEMBERED = 400_000

# Fixed values of the tokenizer's own split pattern, as its file states them.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose case, composition and class Python and the library agree about, and which don't depend on
#: their neighbours: Latin letters, common marks and white space. Others are left to the library.
PLAIN = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122]))


class WordTokenizer:
    """The ids of `tokenizers` for a word-BPE file, as little-endian unsigned 32-bit bytes.

    No token spans white space and none depends on its neighbours across it, so the ids of a text are
    those of its white-space words in a row; a word's ids are those of the runs that the file's pattern
    splits it into. Both are remembered, and only new runs go through the library's merges. A text with
    any character outside PLAIN, or with one of these that the library proves to treat otherwise when
    a tokenizer starts, or with a special token, goes through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(SPLIT_PATTERN)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        agreed = "".join(c for c in PLAIN if all(b"".join(map(self._word, t.split())) == self._library(t) for t in (c, f"a{c}B", f"{c}{c} x")))
        self.odd = re.compile("|".join([f"[^{re.escape(agreed)}]", *map(re.escape, self.special)]))

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) >= REMEMBERED:
                self.runs.clear()
            ids = [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.bytes))]
            got = self.runs[run] = np.array(ids, "<u4").tobytes()
        return got

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha():
            return self._run(low)
        return b"".join(map(self._run, self.split.findall(low)))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return self._library(text)
        known, parts = self.words, text.split()
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) >= REMEMBERED:
            known.clear()
        out = []
        for w in parts:
            got = known.get(w)
            if got is None:
                got = self._word(w)
                if len(w) <= 64:
                    known[w] = got
            out.append(got)
        return b"".join(out)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """A worker's tokenizer: what it remembers serves the worker's later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where
    they are more than a sequence holds. A null text is empty: its piece is the end id alone."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer_of(path), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = tok.ids(text) + end
                n = len(data) // 4
                for k, at in enumerate(range(0, n, CAPACITY)):
                    part = data[4 * at : 4 * (at + CAPACITY)]
                    rows.append((i, k, at, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Sequences by the room they have left; the fullest that still takes a length is found by bits."""

    def __init__(self) -> None:
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(CAPACITY + 1)]
        self.mask = 0

    def put(self, b: int) -> None:
        room = self.room[b]
        self.by_room[room].append(b)
        self.mask |= 1 << room

    def open(self, items: list[int], length: int) -> None:
        self.items.append(items)
        self.room.append(CAPACITY - length)
        self.put(len(self.items) - 1)

    def best_fit(self, item: int, length: int) -> None:
        fits = self.mask >> length
        if not fits:
            self.open([item], length)
            return
        room = length + (fits & -fits).bit_length() - 1
        b = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.items[b].append(item)
        self.room[b] = room - length
        self.put(b)


def _price(steps: list[int], worth: np.ndarray) -> tuple[float, np.ndarray]:
    """The configuration (how many of each size, in steps) that is worth most in a sequence: a knapsack."""
    room = CAPACITY // STEP
    best, history = np.zeros(room + 1), []
    for i, size in enumerate(steps):
        if worth[i] <= 1e-12:
            continue
        copies = room // size
        while copies:  # lots of 1, 2, 4, ... copies make any number of them
            lot = min(copies, 1 << (room // size - copies).bit_length())
            grown = best.copy()
            np.maximum(best[size * lot :], best[: room + 1 - size * lot] + worth[i] * lot, out=grown[size * lot :])
            history.append((i, lot, best))
            best = grown
            copies -= lot
    use, at, value = np.zeros(len(steps)), room, float(best[room])
    for i, lot, before in reversed(history):
        if best[at] > before[at]:
            use[i] += lot
            at -= steps[i] * lot
        best = before
    return value, use


def configurations(sizes: list[int], counts: list[int]) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, in parts of sequences too, so that all of `counts` are
    held by the fewest sequences: the linear program by column generation. A configuration enters the basis if
    it is worth more than a sequence at the basis's prices, till none is or the bound is close."""
    n = len(sizes)
    steps = [-(-s // STEP) for s in sizes]
    basis = np.diag([float(CAPACITY // STEP // s) for s in steps])
    need = np.array(counts, float)
    used = np.linalg.solve(basis, need)
    for _ in range(MAX_ROUNDS):
        value, enter = _price(steps, np.linalg.solve(basis.T, np.ones(n)))
        if value <= 1 + GAP:  # all prices divided by value are a bound of the program
            break
        change = np.linalg.solve(basis, enter)
        some = np.flatnonzero(change > 1e-9)
        leave = some[np.argmin(used[some] / change[some])]
        basis[:, leave] = enter
        used = np.maximum(np.linalg.solve(basis, need), 0)
    return [(np.rint(basis[:, k]).astype(int), float(used[k])) for k in range(n)]


def grouped(lengths: np.ndarray, order: np.ndarray) -> Bins:
    """Linear grouping: large lengths are rounded up to the longest of their group, the groups being of
    equal cardinality; the program over these few sizes tells how often each configuration is used,
    rounded down; actual pieces take the places of their group; the others, small ones and those that
    rounding left over, follow where they fit best, longest first."""
    bins = Bins()
    large = [int(i) for i in order if LARGE < lengths[i] < CAPACITY]
    loose = [int(i) for i in order if lengths[i] <= LARGE]
    for i in order:
        if lengths[i] == CAPACITY:
            bins.open([int(i)], CAPACITY)
    each = max(1, -(-len(large) // GROUPS))
    left = [list(reversed(large[k : k + each])) for k in range(0, len(large), each)]
    if left:
        plan = configurations([int(lengths[g[-1]]) for g in left], [len(g) for g in left])
        for use, often in plan:
            for _ in range(int(often + 1e-6)):
                if any(len(left[k]) < u for k, u in enumerate(use)):
                    break
                items = [left[k].pop() for k, u in enumerate(use) for _ in range(u)]
                bins.open(items, int(sum(lengths[i] for i in items)))
    loose += [i for g in left for i in g]
    _fit(bins, loose, lengths)
    for part in REOPEN:
        again = Bins()
        loose = []
        for items, room in zip(bins.items, bins.room, strict=True):
            if CAPACITY - room < part * CAPACITY:
                loose += items
            else:
                again.open(list(items), CAPACITY - room)
        _fit(again, loose, lengths)
        if len(again.items) <= len(bins.items):
            bins = again
    return bins


def _fit(bins: Bins, items: list[int], lengths: np.ndarray) -> None:
    for i in sorted(items, key=lambda i: (-int(lengths[i]), i)):
        bins.best_fit(i, int(lengths[i]))


def pack(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, sequences) for lengths of 1 to CAPACITY: by linear grouping, or by best fit of all
    pieces, longest first, if that takes fewer sequences. Ties go by the order of the lengths."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins = grouped(lengths, order)
    if len(bins.items) * CAPACITY - int(lengths.sum()) >= CAPACITY:  # else no packing has fewer
        plain = Bins()
        _fit(plain, order.tolist(), lengths)
        if len(plain.items) < len(bins.items):
            bins = plain
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            seq[i], offset[i] = b, at
            at += int(lengths[i])
    return seq, offset, len(bins.items)


def _pack_shards(cut: DataFrame, round_no: int) -> DataFrame:
    """Pack the rows of `cut`, a written table, in shards of about SHARD_SEQUENCES sequences' tokens; `fill`
    is the length of a row's sequence."""
    tokens = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, tokens // (SHARD_SEQUENCES * CAPACITY))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row", F.lit(round_no)), F.lit(shards)).cast("long"))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable", ignore_index=True)
        length = pdf["length"].to_numpy()
        seq, offset, n = pack(length)
        pdf["sequence_id"], pdf["offset"] = (pdf["shard"] * 2 + round_no) * (1 << 32) + seq, offset
        pdf["fill"] = np.bincount(seq, length, n).astype(np.int64)[seq]
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "row", "sequence_id", "offset", "fill"]]

    return dealt.groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """A row for each piece of `docs(doc_id, text, ...)`: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null or empty text is a piece of the end id alone; texts are read whole, and only those of more
    ids than a sequence holds are cut. Shards are packed each for itself; their loosely filled
    sequences meet in a second round. Equal lengths go by the rows' order; repeated rows are packed each for
    itself. Other columns aren't read. Empty input: empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    cut = scratch.save(pieces(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    first = scratch.save(_pack_shards(cut, 0))
    again = scratch.save(_pack_shards(first.where(F.col("fill") < LOOSE).select(*cut.columns), 1))
    both = first.where(F.col("fill") >= LOOSE).unionByName(again)
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
