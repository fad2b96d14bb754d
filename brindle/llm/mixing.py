"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks of words."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.shared import Scratch, bounded_batches, free_name

MAX_PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source are dealt into shards of about this many.
SHARD_DOCS = 1024
#: Words of a block, at most; a source has this many blocks at least, if it has the words.
BLOCK_WORDS = 4096
LEAST_BLOCKS = 64
#: Rows (of about 40 bytes) of a plan that may be broadcast.
MAX_BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], passes: int = MAX_PASSES) -> list[float]:
    """Words for each source: its share of all sizes by weight, at most `passes` times its size, the
    excess shared again by weight among the others until none is above."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * per > passes * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * per
            break
        for i in full:
            out[i] = float(passes * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(shares: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients share/(2k+1), none beyond `most`; ties go to the lower index.

    A start below the end result comes from the divisor, the last seats from a heap of quotients.
    """
    n = len(shares)
    seats = int(min(seats, most.sum()))
    got = np.zeros(n, np.int64)
    if not n or seats <= 0 or shares.sum() <= 0:
        return got
    lo, hi = 0.0, 2.0 * float(shares.max()) + 1.0
    for _ in range(200):  # the largest divisor known to give at least the seats is lo
        mid = (lo + hi) / 2
        if mid <= 0 or np.minimum(np.floor(shares / mid + 0.5), most).sum() >= seats:
            lo = mid
        else:
            hi = mid
    got = np.minimum(np.maximum(np.floor(shares / hi + 0.5), 0), most).astype(np.int64)
    while got.sum() > seats:
        got[int(np.argmax(got))] -= 1
    heap = [(-shares[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < most[i] and shares[i] > 0]
    heapq.heapify(heap)
    while got.sum() < seats and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def _sources(sized: DataFrame) -> tuple[DataFrame, int]:
    """(number, source, source_size, target, seats, block, shards) for each source, and how many there are.

    The driver holds a row for each source: weights go by the sources' order and targets by all sizes
    together. Words are apportioned to sources by highest quotients, so none is too small for a share; a
    source's blocks are equal and as long as its seats allow.
    """
    totals = [(r["source"], r["docs"], r["words"]) for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("words")).collect()]
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    words = [r[2] for r in totals]
    goal = targets(words, [1.0 + i % 3 for i in range(len(totals))])
    seats = sainte_lague(np.array(goal), round(sum(goal)), np.array([MAX_PASSES * w for w in words], np.int64))
    rows = [(i, s, w, float(g), int(q), max(1, min(BLOCK_WORDS, int(q) // LEAST_BLOCKS)), max(1, -(-n // SHARD_DOCS))) for i, ((s, n, w), g, q) in enumerate(zip(totals, goal, seats, strict=True))]
    return sized.sparkSession.createDataFrame(rows, "number int, source string, source_size long, target double, seats long, block long, shards int"), len(rows)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a plan of few rows; beyond MAX_BROADCAST_ROWS it is joined by shuffle."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def shard_quotas(words: np.ndarray, seats: int, block: int) -> np.ndarray:
    """Words that each shard of a source gives: whole passes first, which all shards make alike, then whole
    blocks by highest quotients, and the words that are no whole block to the next quotients."""
    total = int(words.sum())
    if not total:
        return np.zeros(len(words), np.int64)
    passes, rest = divmod(int(seats), total)
    blocks = sainte_lague(words.astype(np.float64), rest // block, words // block)
    got = blocks * block
    left = rest - int(got.sum())
    got += sainte_lague(words.astype(np.float64), left, words - got)
    return got + passes * words


def choose_words(sizes: np.ndarray, quota: int, block: int, seed: int) -> tuple[int, list[list[tuple[int, int]]]]:
    """(passes, for each document the runs of its words that are taken once more) of a shard whose documents
    stand in a row: the row is cut into blocks, a seeded choice of them is taken whole, and the words
    that are no whole block come from the start of the next block chosen."""
    total = int(sizes.sum())
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if not total:
        return 0, out
    passes, rest = divmod(quota, total)
    if not rest:
        return passes, out
    starts = np.arange(0, total, block)
    lengths = np.minimum(block, total - starts)
    order = np.random.default_rng(seed).permutation(len(starts))
    upto = np.cumsum(lengths[order])
    taken = np.clip(rest - (upto - lengths[order]), 0, lengths[order])
    chosen = np.sort(order[taken > 0])
    part = dict(zip(order.tolist(), taken.tolist(), strict=True))
    ends = np.cumsum(sizes)
    for b in chosen.tolist():
        lo = int(starts[b])
        hi = lo + part[b]
        doc = int(np.searchsorted(ends, lo, side="right"))
        while lo < hi:
            first = int(ends[doc] - sizes[doc])
            stop = min(hi, int(ends[doc]))
            if stop > lo:
                run = (lo - first, stop - first)
                if out[doc] and out[doc][-1][1] == run[0]:
                    out[doc][-1] = (out[doc][-1][0], run[1])
                else:
                    out[doc].append(run)
            lo, doc = max(lo, stop), doc + 1
    return passes, out


PLANNED = "row long, doc_id {}, size long, source_size long, target double, whole long, ranges array<struct<from:long,to:long>>, taken long"


def mix(docs: DataFrame, seed: int = 17, scratch: Scratch | None = None, row: str | None = None) -> DataFrame:
    """Plan the mix of `docs(doc_id, text, source, ...)`.

    Returns row, doc_id, size, source_size, target, whole (passes that take all of the document), ranges
    (runs of words, from and to, taken once more) and taken (all words, repeats counted). Sources in
    code-point order, null last, weigh 1, 2, 3, repeating; a source of no words takes none. Words are
    apportioned to sources, and a source's blocks to its shards, by highest quotients; a shard lays its
    documents out in seeded order, cuts that row into blocks and takes a seeded choice of as many as
    its quota. A document gives a word at most 3 times. The choice depends on ids, texts and the seed
    alone; equal rows are told apart by their place. Null and empty texts have size 0 and give nothing.
    Texts are read whole. Other columns aren't read. Empty input: empty result. `row` names a column of
    unique longs, else one is made.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sized = scratch.save(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")))
    sources, n = _sources(sized)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mark"), F.lit(seed))
    named = sized.join(_small(sources, n), sized["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "size", "source_size", "target", "number", "block", key.alias("order"), "mark", F.pmod(F.xxhash64(key, F.lit("shard")), F.col("shards")).cast("int").alias("shard"))
    named = scratch.save(named)

    def apportion(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        pdf["quota"] = shard_quotas(pdf["words"].to_numpy(), int(pdf["seats"].iloc[0]), int(pdf["block"].iloc[0]))
        return pdf[["number", "shard", "quota"]]

    # a row for each shard: a thousandth of a source's documents
    shards = named.groupBy("number", "shard").agg(F.sum("size").alias("words")).join(_small(sources.select("number", "seats", "block"), n), "number")
    quotas = scratch.save(shards.groupBy("number").applyInPandas(apportion, "number int, shard int, quota long"))
    laid = named.join(quotas.hint("merge"), ["number", "shard"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "mark", "row"], ignore_index=True)
        first = pdf.iloc[0]
        sizes = pdf["size"].to_numpy()
        passes, ranges = choose_words(sizes, int(first["quota"]), int(first["block"]), abs(int(first["number"]) * 1_000_003 + int(first["shard"])) * 31 + seed)
        pdf["whole"] = passes
        pdf["ranges"] = [[{"from": a, "to": b} for a, b in r] for r in ranges]
        pdf["taken"] = passes * sizes + np.array([sum(b - a for a, b in r) for r in ranges], np.int64)
        return pdf[["row", "doc_id", "size", "source_size", "target", "whole", "ranges", "taken"]]

    return laid.groupBy("number", "shard").applyInPandas(choose, PLANNED.format(docs.schema["doc_id"].dataType.simpleString()))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents, with the columns of `docs`, whatever their names: a row for each full pass over a
    document, and one more with the part of its text that chosen words cover, where they cover a part.
    n_chars, if there, follows. Documents without a word are never chosen and go. Cases as in `mix`."""
    scratch = Scratch(docs.sparkSession, "mix-stage")
    number, parts, whole = free_name(docs, "number"), free_name(docs, "parts"), free_name(docs, "whole")
    mine = scratch.save(docs.withColumn(number, F.monotonically_increasing_id()))
    rows = mix(mine, seed, scratch, number).where("taken > 0")
    full = F.exists("ranges", lambda p: (p["from"] == 0) & (p["to"] == F.col("size")))
    passes = (F.col("whole") + F.when(full, 1).otherwise(0)).cast("int")
    some = F.when(~full & (F.size("ranges") > 0), F.col("ranges"))
    modes = F.concat(F.array_repeat(F.lit(True), passes), F.when(some.isNotNull(), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    use = scratch.save(rows.select(F.col("row").alias(number), some.alias(parts), modes.alias(whole)))
    copies = mine.join(use.hint("merge"), number).withColumn(whole, F.explode(whole))
    bounded_batches(docs.sparkSession)
    cut = F.pandas_udf(_cut, T.StringType())
    text = F.when(F.col(whole), F.col("text")).otherwise(cut(F.when(~F.col(whole), F.col("text")), F.when(~F.col(whole), F.col(parts))))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _cut(text, ranges):
    import re

    word = re.compile(WORD)
    out = []
    for t, some in zip(text, ranges, strict=True):
        if t is None or some is None:
            out.append(None)
            continue
        spans = [m.span() for m in word.finditer(t)]
        out.append(" ".join(t[spans[r["from"]][0] : spans[r["to"] - 1][1]] for r in some if r["to"] > r["from"]))
    return pd.Series(out)


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """A row for each row of `docs`: doc_id, size, source_size, target, taken. Cases as in `mix`."""
    return mix(docs, seed).select("doc_id", "size", "source_size", "target", "taken")
