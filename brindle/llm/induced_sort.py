"""Suffix sorting by induction, with common prefixes carried along and queues that spill to disk.

Texts are byte strings without 0xFF and end in a separator of their own each, smaller than any byte.
Order and common prefixes are exact up to `depth` bytes, which is what a search for repeats of that
length needs; suffixes that agree so far are neighbours.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes of a block that one 64-bit key names; the eighth looks ahead.
STEP = 7


class SpillQueue:
    """A monotone priority queue of suffix tuples: by leading symbol, then in order of arrival.

    A tuple is a position and the rank of the suffix that follows it. Induction pushes tuples in the
    order of those ranks, so arrival order is rank order. Beyond `limit` bytes in memory, the tuples of
    the symbols that are due last go to a file.
    """

    def __init__(self, limit: int, folder: str | None = None, descending: bool = False):
        self.limit, self.folder, self.descending = limit, folder, descending
        self.parts: dict[int, list] = {}
        self.held = 0
        self.file = None
        self.spilled = 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols, positions, ranks = symbols[order], positions[order], ranks[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for s, e in zip(np.append(0, cuts), np.append(cuts, len(symbols)), strict=True):
            if e > s:
                self.parts.setdefault(int(symbols[s]), []).append(np.stack([positions[s:e], ranks[s:e]]))
                self.held += (e - s) * 16
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        for symbol in sorted(self.parts, reverse=not self.descending):
            if self.held <= self.limit // 2:
                break
            for k, part in enumerate(self.parts[symbol]):
                if isinstance(part, np.ndarray):
                    at = self.file.seek(0, os.SEEK_END)
                    part.tofile(self.file)
                    self.parts[symbol][k] = (at, part.shape[1])
                    self.held -= part.shape[1] * 16
                    self.spilled += 1

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a symbol, in order."""
        found = []
        for part in self.parts.pop(symbol, []):
            if isinstance(part, tuple):
                self.file.seek(part[0])
                found.append(np.fromfile(self.file, np.int64, part[1] * 2).reshape(2, -1))
            else:
                found.append(part)
                self.held -= part.shape[1] * 16
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.concatenate(found, axis=1)
        return both[0], both[1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Emitted:
    """Suffixes in the order they come out, with the prefix each shares with the one before."""

    def __init__(self, n: int):
        self.order = np.zeros(n, np.int64)
        self.lcp = np.zeros(n, np.int16)
        self.n = 0

    def add(self, positions: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        at = np.arange(self.n, self.n + len(positions))
        self.order[at[0] : at[-1] + 1], self.lcp[at[0] : at[-1] + 1] = positions, lcp
        self.n += len(positions)
        return at

    def shared(self, ranks: np.ndarray, before: int, depth: int) -> np.ndarray:
        """Common prefixes of suffixes in a row, from those of the suffixes that follow them: one more
        than the least between two ranks. `before` is the rank ahead of the first, or -1 for none."""
        out = np.zeros(len(ranks), np.int16)
        if before >= 0:
            ranks = np.append(before, ranks)
        if len(ranks) > 1:
            least = np.minimum.reduceat(self.lcp[: int(ranks[-1]) + 1], ranks[:-1] + 1)
            out[len(out) - len(least) :] = np.minimum(least + 1, depth)
        return out


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S type, S* type) of each symbol; a separator is S*."""
    n = len(t)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    sign[-1] = 1
    sign[t == 0] = 1
    known = np.where(sign != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(known[::-1])[::-1]  # the end of a run of equal symbols decides
    s = sign[nearest] > 0
    star = s.copy()
    star[1:] &= ~s[:-1]
    star[0] = False
    star[t == 0] = True
    return s, star


def star_order(t: np.ndarray, star: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of S* suffixes in order, the blocks' ranks are exact to `depth` bytes).

    Substrings from one S* to the next are named by 64-bit keys, long ones in several blocks; the
    string of names is sorted by recursion on pairs of names.
    """
    n = len(t)
    stars = np.flatnonzero(star)
    following = np.append(stars[1:], n)
    gap = following - stars
    many = np.where(t[stars] == 0, 1, np.maximum(1, -(-gap // STEP)))
    node_star = np.repeat(np.arange(len(stars)), many)
    step_no = np.arange(len(node_star)) - np.repeat(np.cumsum(many) - many, many)
    pos = stars[node_star] + STEP * step_no
    end = following[node_star]
    padded = np.append(t, np.full(8, 255, np.uint8))
    key = np.zeros(len(pos), np.uint64)
    for k in range(8):
        symbol = np.where(pos + k <= end, padded[np.minimum(pos + k, n + 7)], 255)
        key = (key << np.uint64(8)) | symbol.astype(np.uint64)
    alone = t[pos] == 0
    nxt = np.minimum(np.arange(len(pos)) + 1, len(pos) - 1)
    width = np.diff(np.append(pos, n))
    rank = np.zeros(len(pos), np.int64)
    rank[alone] = np.arange(alone.sum())
    _, names = np.unique(key[~alone], return_inverse=True)
    rank[~alone] = names + alone.sum()
    nxt[alone] = np.flatnonzero(alone)
    width[alone] = depth
    rank = _sort_names(rank, nxt, width, depth)
    mine = np.cumsum(many) - many
    order = np.argsort(rank[mine], kind="stable")
    return stars[order], rank


def _sort_names(rank: np.ndarray, nxt: np.ndarray, width: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of the string of names: each level names pairs of neighbours of the level
    before, until the names are unique or span `depth` bytes."""
    count = np.bincount(rank)
    open_ = np.flatnonzero((count[rank] > 1) & (width < depth))
    if not len(open_):
        return rank
    wide = rank.astype(np.uint64) << np.uint64(32) | rank[nxt].astype(np.uint64)
    _, paired = np.unique(wide, return_inverse=True)
    return _sort_names(paired, nxt[nxt], np.minimum(width + width[nxt], depth), depth)


def suffix_order(t: np.ndarray, depth: int, limit: int = 64 << 20, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each with the one before, at most `depth`) of symbols `t`, where
    0 separates and ends the texts and 255 doesn't occur."""
    n = len(t)
    s, star = classify(t)
    seeds, _ = star_order(t, star, depth)
    ends = np.flatnonzero(t == 0)
    left = (ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)).astype(np.int64)
    padded = np.append(t, np.zeros(depth, np.uint8))
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    seed_lcp = np.zeros(len(seeds), np.int16)
    for k in range(1, len(seeds), 8192):
        a, b = seeds[k - 1 : min(k - 1 + 8192, len(seeds) - 1)], seeds[k : k + 8192]
        diff = windows[a] != windows[b]
        first = np.where(diff.any(1), diff.argmax(1), depth)
        seed_lcp[k : k + 8192] = np.minimum(np.minimum(first, left[a]), left[b])
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    run = change[np.searchsorted(change, np.arange(n))] - np.arange(n) + 1

    # L suffixes, ascending, from separators and S* seeds
    out = Emitted(n)
    queue = SpillQueue(limit, folder)
    of_seed = t[seeds]
    starts = np.searchsorted(of_seed, np.arange(258))
    l_parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def push(q: SpillQueue, at: np.ndarray, positions: np.ndarray, kind: bool) -> None:
        ok = positions > 0
        before = positions[ok] - 1
        good = (s[before] == kind) & (t[before] != 0)
        q.push(t[before[good]], before[good], at[ok][good])

    symbols = np.unique(t).tolist()
    for c in symbols:
        got, lcps, last = [], [], -1
        while True:
            positions, ranks = queue.pop(c)
            if not len(positions):
                break
            lcp = out.shared(ranks, last, depth)
            last = int(ranks[-1])
            at = out.add(positions, lcp)
            got.append(positions)
            lcps.append(lcp)
            push(queue, at, positions, False)
        if got:
            l_parts[c] = np.concatenate(got), np.concatenate(lcps)
        mine = seeds[starts[c] : starts[c + 1]]
        if len(mine):
            lcp = seed_lcp[starts[c] : starts[c + 1]].copy()
            lcp[0] = min(depth, int(run[got[-1][-1]]), int(run[mine[0]])) if got else 0
            at = out.add(mine, lcp)
            push(queue, at, mine, False)
    queue.close()

    # S suffixes, descending, from L suffixes and those before
    down = Emitted(n)
    queue = SpillQueue(limit, folder, descending=True)
    for c in reversed(symbols):
        if c == 0:
            down.add(ends[::-1], np.zeros(len(ends), np.int16))
            break
        last, smallest = -1, None
        while True:
            positions, ranks = queue.pop(c)
            if not len(positions):
                break
            lcp = down.shared(ranks, last, depth)
            last = int(ranks[-1])
            at = down.add(positions, lcp)
            smallest = positions[-1]
            push(queue, at, positions, True)
        if c in l_parts:
            positions, up = l_parts[c]
            lcp = np.append(0, up[:0:-1]).astype(np.int16)
            if smallest is not None:
                lcp[0] = min(depth, int(run[smallest]), int(run[positions[-1]]))
            at = down.add(positions[::-1], lcp)
            push(queue, at, positions[::-1], True)
    queue.close()
    order = down.order[: down.n][::-1]
    lcp = np.append(0, down.lcp[1 : down.n][::-1]).astype(np.int16)
    return order, lcp
