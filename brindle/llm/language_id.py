"""Language identification by a byte-level convolutional network in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, fold

#: Labelled documents that the network is fitted on at most, the first by a hash of their id.
TRAIN_DOCS = 3000
#: Windows of all their texts that training takes at most, evenly by a seeded draw.
TRAIN_WINDOWS = 18_000
WINDOW = 128
EMBED = 8
#: Filters for each width in bytes.
FILTERS = {2: 12, 3: 18, 4: 18}
WIDEST = max(FILTERS)
#: Windows that go through the network at once.
BATCH = 256
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows_of(data: bytes) -> np.ndarray:
    """All bytes of a text in consecutive fixed-length windows, the last one padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class ByteConvNet:
    """Byte embedding, convolutions of several widths, ReLU, max pooling over the window, softmax."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        total = sum(FILTERS.values())
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.conv = np.zeros((WIDEST * EMBED, total), np.float32)
        self.mask = np.zeros_like(self.conv)
        at = 0
        for width, count in FILTERS.items():  # narrower filters are rows of zeros at the end
            self.mask[: width * EMBED, at : at + count] = 1
            self.conv[: width * EMBED, at : at + count] = rng.normal(0, np.sqrt(2 / (width * EMBED)), (width * EMBED, count))
            at += count
        self.conv_bias = np.zeros(total, np.float32)
        self.dense = rng.normal(0, 0.1, (total, max(1, len(languages)))).astype(np.float32)
        self.dense_bias = np.zeros(max(1, len(languages)), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        e = self.embed[windows].reshape(len(windows), -1)
        e = np.concatenate([e, np.zeros((len(windows), (WIDEST - 1) * EMBED), np.float32)], 1)
        s0, s1 = e.strides
        view = np.lib.stride_tricks.as_strided(e, (len(windows), WINDOW, WIDEST * EMBED), (s0, s1 * EMBED, s1))
        return view.reshape(len(windows) * WINDOW, WIDEST * EMBED)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        maps = (self._columns(windows) @ self.conv).reshape(len(windows), WINDOW, -1)
        return np.maximum(maps.max(axis=1) + self.conv_bias, 0)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(windows), BATCH):
            z = self.pooled(windows[k : k + BATCH]) @ self.dense + self.dense_bias
            z = z - z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, self.dense.shape[1]), np.float32)

    def gradients(self, x: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of windows x with languages t: for embed, conv, conv_bias, dense,
        dense_bias. Only the byte run that won the pooling gets one."""
        n = len(x)
        cols = self._columns(x)
        maps = (cols @ self.conv).reshape(n, WINDOW, -1)
        top = maps.argmax(axis=1)
        pre = np.take_along_axis(maps, top[:, None, :], 1)[:, 0] + self.conv_bias
        hidden = np.maximum(pre, 0)
        z = hidden @ self.dense + self.dense_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), t] -= 1
        p /= n
        g_hidden = (p @ self.dense.T) * (pre > 0)
        won = cols.reshape(n, WINDOW, -1)[np.arange(n)[:, None], top]
        g_conv = np.einsum("nfk,nf->kf", won, g_hidden) * self.mask
        g_cols = g_hidden[:, :, None] * self.conv.T[None]
        g_embed = np.zeros_like(self.embed)
        for o in range(WIDEST):
            at = top + o
            inside = at < WINDOW
            byte = np.where(inside, x[np.arange(n)[:, None], np.minimum(at, WINDOW - 1)], 0)
            np.add.at(g_embed, byte, g_cols[:, :, o * EMBED : (o + 1) * EMBED] * inside[:, :, None])
        g_embed[0] = 0
        return [g_embed, g_conv, g_hidden.sum(0), hidden.T @ p, p.sum(0)]

    def fit(self, windows: np.ndarray, y: np.ndarray, epochs: int = 4, rate: float = 3e-3, seed: int = 3) -> None:
        """Adam on the cross-entropy, in seeded mini-batches of 64 windows."""
        rng = np.random.default_rng(seed)
        params = [self.embed, self.conv, self.conv_bias, self.dense, self.dense_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), 64):
                pick = order[k : k + 64]
                step += 1
                for i, g in enumerate(self.gradients(windows[pick], y[pick])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def predict(model: ByteConvNet, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: the windows' log-probabilities weighted by their bytes.
    A null text, and one with no letter, is `und` with score 0."""
    data = [t.encode("utf-8", "replace") if t is not None and _LETTER.search(t) else None for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    some = [d for d in data if d is not None]
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not some:
        return names, scores
    parts = [windows_of(d) for d in some]
    logs = model.log_probs(np.concatenate(parts)).astype(np.float64)
    sizes = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(w))) for d, w in zip(some, parts, strict=True)])
    starts = np.concatenate([[0], np.cumsum([len(w) for w in parts])[:-1]])
    total = np.add.reduceat(logs * (sizes / WINDOW)[:, None], starts, axis=0)
    weight = np.add.reduceat(sizes / WINDOW, starts)
    total /= np.maximum(1.0, np.sqrt(weight))[:, None]  # neighbouring windows aren't independent
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = iter(zip(p.argmax(1), p.max(1), strict=True))
    for i, d in enumerate(data):
        if d is not None:
            k, s = next(best)
            names[i], scores[i] = model.languages[int(k)], float(s)
    return names, scores


def train(docs: DataFrame, limit: int = TRAIN_DOCS, windows: int = TRAIN_WINDOWS, seed: int = 3) -> ByteConvNet:
    """Fit on at most `limit` documents with a language whose fold isn't 0, and on at most about `windows`
    of their windows: all windows of the whole texts take part in the seeded draw. Some are cut to
    seeded lengths, so that short texts are learned too."""
    some = docs.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    ids = F.broadcast(some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most `limit` numbers
    chosen = some.select("doc_id", "text", "lang").join(ids, "doc_id")
    total = chosen.agg(F.coalesce(F.sum(F.ceil(F.octet_length("text") / F.lit(WINDOW))), F.lit(0))).first()[0]
    share = min(1.0, windows / max(1, total))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, lang, win = [], [], []
            for d, text, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not _LETTER.search(text):
                    continue
                data = text.encode("utf-8", "replace")
                every = windows_of(data)
                rng = np.random.default_rng(zlib.crc32(data) ^ seed)
                draws = rng.random((len(every), 3))
                for k in np.flatnonzero(draws[:, 0] < share):
                    size = WINDOW if draws[k, 1] < 0.6 else 4 + int(draws[k, 2] * (WINDOW - 4))
                    doc.append(d)
                    lang.append(name)
                    win.append(every[k].tobytes()[:size].ljust(WINDOW, b"\0"))
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(lang, pa.string()), pa.array(win, pa.binary())], names=["doc_id", "lang", "win"])

    got = chosen.mapInArrow(cut, "doc_id long, lang string, win binary").toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("lang").to_pylist(), got.column("win").to_pylist(), strict=True))
    names = sorted({r[1] for r in rows})
    model = ByteConvNet(names, seed)
    if len(names) > 1:
        x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
        place = {n: i for i, n in enumerate(names)}
        y = np.array([place[r[1]] for r in rows])
        model.fit(x, y, epochs=max(4, min(40, 60_000 // max(1, len(rows)))))
    return model


def identify(docs: DataFrame, model: ByteConvNet | None = None) -> DataFrame:
    """A row for each row of `docs(doc_id, text, lang, ...)`: doc_id, held_out, lang_pred, score.

    Predictions read the whole text, of any length, and nothing else. A null text and one without a
    letter (\\p{L}; numerals aren't) are `und` with score 0. Where no row to learn from has a language, all are
    `und`. Repeated rows are predicted each; a null doc_id is held out. Other columns aren't read.
    Empty input: empty result.
    """
    bounded_batches(docs.sparkSession)
    model = model or train(docs)
    narrow = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            texts = b.column(2).to_pylist()
            for k in range(0, len(texts), 64):
                n, s = predict(model, texts[k : k + 64])
                names += n
                scores += s
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
