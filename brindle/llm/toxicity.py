"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, fold

#: Labelled documents that the model is fitted on at most, the first by a hash of their id.
TRAIN_DOCS = 8_000
#: Hashed terms of the model: all words and prefixes of all texts fall to one of these, none is left out.
DIM = 1 << 18
FACTORS = 8
#: A term that fewer training documents hold has nothing to learn from; its weights stay zero.
MIN_DOCS = 3
PREFIXES = (5, 7)
#: Training: the weight of a toxic row, the linear weights' fixed step to zero, the factors' part, the epochs
#: without a gain on held-back rows that end it, and the factors' rate beside the weights'.
LIFT, SHRINK, DECAY, PATIENCE, V_RATE = 3.0, 2e-3, 5e-2, 3, 0.05
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> tuple[int, ...]:
    """The hashed terms of a lower-case word: itself, and its prefixes of 5 and 7 letters."""
    names = [f"w:{word}", *(f"p{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & (DIM - 1) for x in names)


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


class FactorizationMachine:
    """score(x) = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i being 1 for each term present.

    Weights and factors of all `dim` hashed terms are arrays, so memory is bounded whatever the texts hold.
    """

    def __init__(self, dim: int = DIM, factors: int = FACTORS):
        self.bias = 0.0
        self.w = np.zeros(dim, np.float32)
        self.v = np.zeros((dim, factors), np.float32)
        self.paired = False  # whether factors are learned, else they are zero

    def raw(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of rows whose terms are ids[starts[r]:starts[r+1]], and the factor sums. The pairwise sum
        is half of the squared sums less the sums of squares."""
        n = len(starts) - 1
        lin, sums, squares = np.zeros(n), np.zeros((n, self.v.shape[1])), np.zeros(n)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            at = starts[:-1][some]
            lin[some] = np.add.reduceat(self.w[ids], at, dtype=np.float64)
            if self.paired:
                v = self.v[ids]
                sums[some] = np.add.reduceat(v, at, axis=0, dtype=np.float64)
                squares[some] = np.add.reduceat((v * v).sum(1), at, dtype=np.float64)
        return self.bias + lin + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, starts)[0], -40, 40)))

    def loss(self, rows: list[np.ndarray], y: np.ndarray) -> float:
        s = np.clip(self.score(*_joined(rows)), 1e-7, 1 - 1e-7)
        return float(-np.mean(np.where(y > 0, LIFT * np.log(s), np.log(1 - s))))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, linear_epochs: int = 12, epochs: int = 20, rate: float = 0.1, seed: int = 5, least: int = MIN_DOCS) -> None:
        """AdaGrad on the logistic loss, a toxic row counting LIFT times, in seeded mini-batches: linear
        weights first, shrunk towards zero by a fixed step (L1), then weights and factors together.

        An eighth of the rows is held back; factors are those of the epoch that did best there, or none
        if the linear part did. Factors start small and random, those of terms in fewer than `least`
        rows stay zero."""
        rng = np.random.default_rng(seed)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        known = np.bincount(np.concatenate(rows), minlength=len(self.w)) >= least if rows else np.zeros(len(self.w), bool)
        rows = [r[known[r]] for r in rows]
        order = rng.permutation(len(rows))
        held, used = order[: len(rows) // 8], order[len(rows) // 8 :]
        held_rows, held_y = [rows[i] for i in held], y[held]
        grads = [np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6]
        for _ in range(linear_epochs):
            self._epoch(rows, y, rng.permutation(used), grads, rate)
        if not len(held) or not self.v.shape[1]:
            return
        best, kept, worse = self.loss(held_rows, held_y), None, 0
        linear = self.bias, self.w.copy()
        self.v[known] = rng.normal(0, 0.02, (int(known.sum()), self.v.shape[1]))
        self.paired = True
        for _ in range(epochs):
            self._epoch(rows, y, rng.permutation(used), grads, rate)
            now = self.loss(held_rows, held_y)
            worse = 0 if now < best else worse + 1
            if now < best:
                best, kept = now, (self.bias, self.w.copy(), self.v.copy())
            if worse >= PATIENCE:
                break
        if kept:
            self.bias, self.w, self.v = kept
        else:
            (self.bias, self.w), self.paired = linear, False
            self.v[:] = 0

    def _epoch(self, rows: list[np.ndarray], y: np.ndarray, order: np.ndarray, grads: list, rate: float) -> None:
        gw, gv, _ = grads
        for k in range(0, len(order), 128):
            pick = order[k : k + 128]
            ids, starts = _joined([rows[i] for i in pick])
            raw, sums = self.raw(ids, starts)
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[pick]) * np.where(y[pick] > 0, LIFT, 1.0) / len(pick)
            grads[2] += err.sum() ** 2
            self.bias -= rate * err.sum() / np.sqrt(grads[2])
            if not len(ids):
                continue
            row = np.repeat(np.arange(len(pick)), np.diff(starts))
            place = np.argsort(ids, kind="stable")
            ids, row = ids[place], row[place]
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            at, e = ids[cuts], err[row].astype(np.float32)
            total = np.add.reduceat(e, cuts)
            gw[at] += total * total
            step = rate / np.sqrt(gw[at])
            w = self.w[at] - step * total
            self.w[at] = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK, 0)
            if self.paired:
                v = self.v[at]
                dv = np.add.reduceat(e[:, None] * sums.astype(np.float32)[row], cuts, axis=0) - total[:, None] * v + DECAY * v
                gv[at] += dv * dv
                self.v[at] = v - V_RATE * rate * dv / np.sqrt(gv[at])


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all rows, where each row starts and the last one ends)."""
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, factors: int = FACTORS) -> FactorizationMachine:
    """Fit on at most `limit` labelled documents whose fold isn't 0, with all their terms. A document with
    several labels is toxic if one says so; rows that repeat an id are trained each, in the order of
    their terms. No labelled rows: a model that scores everything 0."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold(F.col("doc_id")) != 0)
    some = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most `limit` rows of two numbers
    joined = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted({t for w in words_of(x) for t in terms_of(w)}) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([np.array(r, np.int32).tobytes() for r in rows], pa.binary())], names=["doc_id", "toxic", "terms"])

    got = joined.mapInArrow(terms, "doc_id long, toxic int, terms binary").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("terms").to_pylist(), got.column("toxic").to_pylist(), strict=True))
    model = FactorizationMachine(factors=factors)
    if not rows:
        model.bias = -40.0
        return model
    model.fit([np.frombuffer(r[1], np.int32).astype(np.int64) for r in rows], np.array([float(r[2] > 0) for r in rows]))
    return model


def _scorer(model: FactorizationMachine):
    """A function of a list of texts to scores; it remembers the terms of the words it has met."""
    known: dict[str, tuple[int, ...]] = {}
    live = ((model.w != 0) | (model.v != 0).any(1)).tolist()  # the others add nothing to any sum

    def score(texts: list[str | None]) -> np.ndarray:
        ids, ends = [], [0]
        for text in texts:
            mine: set[int] = set()
            for w in words_of(text):
                t = known.get(w)
                if t is None:
                    t = tuple(x for x in terms_of(w) if live[x])
                    if len(known) > 400_000:
                        known.clear()
                    known[w] = t
                if t:
                    mine.update(t)
            ids.extend(sorted(mine))
            ends.append(len(ids))
        return model.score(np.array(ids, np.int64), np.array(ends, np.int64))

    return score


def score_documents(docs: DataFrame, model: FactorizationMachine, keep: list[str] | None = None) -> DataFrame:
    """`keep` (default doc_id), then score (0 to 1) and predicted (1 from 0.5 up), from whole texts alone.
    A null or empty text gets the model's base rate. Rows, repeated or not, are scored one by one."""
    bounded_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for b in batches:
            s = score(b.column(b.num_columns - 1).to_pylist())
            yield pa.record_batch([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "s", "p"])

    schema = ", ".join([*(f"k{i} {narrow.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "s double, p int"])
    return narrow.mapInArrow(run, schema).toDF(*keep, "score", "predicted")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: doc_id, held_out, score, predicted.

    Texts are read whole, of any length; a null or empty text, and one of unknown words, gets the
    model's base rate. Repeated rows are scored each; a null doc_id is held out. Other columns aren't
    read. No labels: all scores are 0. Empty input: empty result.
    """
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, training_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model doesn't reject, with all their columns, whatever their names.
    Cases as in `toxicity_scores`."""
    scored = score_documents(docs, train(training_docs, labels), docs.columns)
    flagged = scored.toDF(*(f"c{i}" for i in range(len(docs.columns))), "s", "p")
    return flagged.where("p = 0").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
