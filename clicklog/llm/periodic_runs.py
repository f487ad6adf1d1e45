"""Periodic runs of words by difference-cover longest common extensions on a harmonic grid.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least ``least`` and
2 q words that no neighbouring word extends. A run of period q holds two neighbouring multiples of q, so it is found by
extending, for each q, the pairs (k q, (k + 1) q) of equal words forward and backward. How far two places agree is a
longest-common-extension query: only suffixes that start at places of a difference cover are sorted; two places are
compared word by word until both reach the cover after the same number of words (at most its modulus and a few), the rest is a
minimum over the sorted suffixes' common prefixes out of a sparse table. The tables are built only for documents in
which a pair agrees that far.

Texts are read whole, one document at a time; the tables take about six integers a word. Nulls: a null text has no
words, a null doc_id is kept. Empty texts and texts without words have no runs. Runs of equal words, ties and repeated
rows need no rule: all runs are returned, rows independently. An empty table gives an empty result. Other columns,
whatever their names, are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^ \t-\r]+")
LEAST = 12
#: A perfect difference set: each remainder is the difference of two of its members.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words compared one by one at least: most pairs part here, and their documents need no tables.
DIRECT = 6
#: Pairs of the grid that are looked at together.
PAIRS = 1 << 18
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@cache
def _shifts() -> np.ndarray:
    """For two places' remainders the least number of words, DIRECT or more, after which both are in the cover."""
    inside = np.isin(np.arange(MODULUS), COVER)
    at = np.arange(MODULUS)
    both = inside[(at[:, None, None] + at + DIRECT) % MODULUS] & inside[(at[None, :, None] + at + DIRECT) % MODULUS]
    return both.argmax(2) + DIRECT


class Extensions:
    """Longest common extensions of pairs of places in a sequence of ids (from 0)."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ids = np.concatenate([ids.astype(np.int64) + 1, np.zeros(MODULUS, np.int64)])
        self.table: list[np.ndarray] | None = None

    def _sort(self) -> None:
        """Rank the cover's suffixes by prefix doubling over blocks of MODULUS words, and tabulate common prefixes."""
        places = np.concatenate([np.arange(r, self.n, MODULUS) for r in COVER])
        m = len(places)
        blocks = np.lib.stride_tricks.sliding_window_view(self.ids, MODULUS)[places]
        keys = np.ascontiguousarray(blocks.astype(">u4")).view(np.dtype((np.void, 4 * MODULUS))).ravel()
        ends = np.repeat(np.cumsum([len(range(r, self.n, MODULUS)) for r in COVER]), [len(range(r, self.n, MODULUS)) for r in COVER])
        rank = np.append(np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1, 0)
        levels, width = [rank], 1
        while rank[:m].max() < m or len(np.unique(rank[:m])) < m:
            ahead = np.arange(m) + width
            later = rank[np.where(ahead < ends, ahead, m)]
            rank = np.append(np.unique(rank[:m] * (m + 1) + later, return_inverse=True)[1].astype(np.int64) + 1, 0)
            levels.append(rank)
            width *= 2
        order = np.argsort(rank[:m])
        # neighbours' common prefixes: whole blocks by falling powers of two, then the words of the first unequal block
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = (a < m) & (b < m) & (levels[level][a] == levels[level][b])
            step = 1 << level
            common[same] += MODULUS * step
            a = np.where(same, np.where(a + step < ends[np.minimum(a, m - 1)], a + step, m), a)
            b = np.where(same, np.where(b + step < ends[np.minimum(b, m - 1)], b + step, m), b)
        blocks = np.concatenate([blocks, np.zeros((1, MODULUS), np.int64)])
        for lo in range(0, m - 1, 1 << 14):
            part = slice(lo, lo + (1 << 14))
            common[part] += (blocks[a[part]] != blocks[b[part]]).argmax(1)
        self.rank = np.full(self.n, -1, np.int64)
        self.rank[places] = rank[:m] - 1
        self.table, half = [common], 1
        while 2 * half <= m - 1:
            last = self.table[-1]
            self.table.append(np.minimum(last[: m - 2 * half], last[half : m - half]))
            half *= 2

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of different places of the cover."""
        if self.table is None:
            self._sort()
        x, y = self.rank[i], self.rank[j]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at, row = np.flatnonzero(level == k), self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words on which the suffixes at ``i`` and ``j`` (each ``i`` < ``j`` <= n) agree."""
        out = np.zeros(len(i), np.int64)
        shift = _shifts()[i % MODULUS, j % MODULUS]
        live = np.arange(len(i))
        for t in range(MODULUS + DIRECT):
            arrived = live[shift[live] == t]
            arrived = arrived[j[arrived] + t < self.n]
            if len(arrived):
                out[arrived] = t + self._sampled(i[arrived] + t, j[arrived] + t)
            live = live[shift[live] > t]
            live = live[self.ids[i[live] + t] == self.ids[np.minimum(j[live] + t, self.n)]]
            if not len(live):
                break
            out[live] += 1
        return out


def _grid(lo: int, hi: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``(j - p, j)`` with lo <= j < hi, p <= ``most`` and p a divisor of j, j > 0."""
    p = np.arange(1, min(most, hi - 1) + 1)
    first, last = -(-max(lo, 1) // p), (hi - 1) // p
    count = last - first + 1
    p, first, count = p[count > 0], first[count > 0], count[count > 0]
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    j = np.repeat(p, count) * (np.repeat(first, count) + step)
    return j - np.repeat(p, count), j


@cache
def _small_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of short documents by ``j``, and for each ``n`` how many pairs have j < n."""
    i, j = _grid(1, 4097, 2048)
    order = np.argsort(j, kind="stable")
    return i[order], j[order], np.searchsorted(j[order], np.arange(4098))


def _pairs(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the grid with equal words, some at a time."""
    n = len(ids)
    if n <= 4097:
        i, j, upto = _small_grid()
        i, j = i[: upto[n]], j[: upto[n]]
        same = np.flatnonzero(ids[i] == ids[j])
        i, j = i[same], j[same]
        short = 2 * (j - i) <= n
        yield i[short], j[short]
        return
    step = max(1, PAIRS // int(np.log(n) + 1))
    for lo in range(1, n, step):
        i, j = _grid(lo, min(lo + step, n), n // 2)
        same = np.flatnonzero(ids[i] == ids[j])
        if len(same):
            yield i[same], j[same]


def _least_period(found: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) the one with the least period for each stretch."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[new]


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a sequence of ids (from 0) as rows ``(start, end, period)`` by start, then period."""
    n = len(ids)
    found = np.zeros((0, 3), np.int64)
    if n < max(least, 2):
        return found
    forward, backward = Extensions(ids), Extensions(ids[::-1])
    for i, j in _pairs(ids):
        ahead = forward.extend(i, j)
        back = backward.extend(n - j, n - i)
        p = j - i
        long = np.flatnonzero(ahead + back >= np.maximum(p, least - p))
        if len(long):
            rows = np.stack([i[long] - back[long], j[long] + ahead[long], p[long]], axis=1)
            found = _least_period(np.concatenate([found, rows]))
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _numbered(words: list[str]) -> np.ndarray:
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs`` (doc_id, text): all runs by start, then period, and
    the text's words, joined by one space, without those that a run repeats. Rows stay where they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        types = [pa.int64(), pa.list_(run), pa.string()]
        for batch in batches:
            at, size = 0, 0
            done: list[tuple] = []
            for k in range(batch.num_rows):
                words = WORD.findall(batch.column(1)[k].as_py() or "")
                found = runs_of(_numbered(words), least)
                runs = [{"start": s, "length": e - s, "period": q} for s, e, q in found.tolist()]
                done.append((len(words), runs, " ".join(collapsed(words, found))))
                size += len(done[-1][2]) + 100 * len(runs)
                if size > 1 << 22 or k == batch.num_rows - 1:  # a few MB at a time
                    columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at : k + 1], *columns], ["doc_id", "n_words", "runs", "collapsed"])
                    at, size, done = k + 1, 0, []

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, SCHEMA)
