"""Spelling variants by a frequency-vector trie: words that differ by one inserted, deleted or replaced code point.

A word's vector counts its code points by letter group. One edit raises one count by one, lowers one, or both, so near
words' vectors differ by a surplus of at most one and a deficit of at most one. Words are arranged in a trie by
successive counts; a search goes down depth first and spends the surplus and the deficit; the words of the leaves that it
reaches are verified code point by code point.

The trie is cut below its first levels: a word is stored in the subtree of its first counts, and is sent as a query, with
what is left of the budget, to each subtree that its own counts reach (only those at or after its own in trie order, so
that a pair meets once). Subtrees are Spark groups. The cut is the least depth at which none holds more than ``most``
words; should all levels be too few, words are also parted by their halves, since one edit leaves one half alone.

Nulls: a null text has no words; a null doc_id counts as the empty text where deletions are drawn. Empty texts have no
words, very long texts are counted in one pass, repeated rows count again. Ties of the largest count go to the
smallest word in code-point order. An empty table gives an empty result. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklog.llm.store import saved, scratch

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Letter groups of the levels, frequent letters first; a code point that none names goes by its number.
GROUPS = ("e", "a", "i", "nm", "o", "tr", "sl", "ué", "dc", "hg", "pb", "")
#: Numbers of levels by which subtrees may be dealt to tasks, and levels that a step below them takes at once.
DEPTHS, STEP = (4, 6, 8, 10, len(GROUPS)), 4
#: Words of a subtree in one task.
MOST = 20_000
#: Counts that a task holds before it passes them on.
HELD = 200_000
#: A level's count takes five bits of a key; larger counts are one, which parts no near words.
BITS, TOP = 5, 31
#: Words verified as rows of a matrix; longer ones are verified one by one.
ROW = 48
_LEVEL = np.array([next((i for i, g in enumerate(GROUPS) if chr(c) in g), len(GROUPS) - 1 if c < 128 else c % len(GROUPS)) for c in range(256)])


def vectors(words: list[str]) -> np.ndarray:
    """Counts by level, one row for each word; words consist of code points below 256."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at = np.repeat(np.arange(len(words)), lengths) * len(GROUPS) + _LEVEL[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    return np.minimum(np.bincount(at, minlength=len(words) * len(GROUPS)), TOP).reshape(len(words), len(GROUPS))


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts of successive levels as one number; numbers are in trie order."""
    return counts @ (1 << BITS * np.arange(counts.shape[1])[::-1])


@cache
def moves(levels: int, surplus: int, deficit: int) -> tuple[tuple[int, int], ...]:
    """Levels at which to spend a surplus and a deficit (or -1), depth first."""

    def down(level: int, up: int, less: int) -> Iterator[tuple[int, int]]:
        if level == levels:
            yield up, less
            return
        yield from down(level + 1, up, less)
        if surplus and up < 0 and less != level:
            yield from down(level + 1, level, less)
        if deficit and less < 0:
            yield from down(level + 1, up, level)

    return tuple(down(0, -1, -1))


def moved(counts: np.ndarray, up: int, less: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows for which a move is possible, and the numbers of what it leads to."""
    able = np.ones(len(counts), bool)
    if up >= 0:
        able &= counts[:, up] < TOP
    if less >= 0:
        able &= counts[:, less] > 0
    rows = np.flatnonzero(able)
    to = packed(counts[rows])
    last = counts.shape[1] - 1
    return rows, to + ((1 << BITS * (last - up)) if up >= 0 else 0) - ((1 << BITS * (last - less)) if less >= 0 else 0)


def near(a: str, b: str) -> bool:
    """Do two words differ by exactly one inserted, deleted or replaced code point?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    while at < len(a) and a[at] == b[at]:
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Words:
    """Words as rows of code points, for verifying many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.left, self.right = (self._matrix([f(w) if len(w) <= ROW else "" for w in words]) for f in (str, lambda w: w[::-1]))

    @staticmethod
    def _matrix(words: list[str]) -> np.ndarray:
        raw = np.frombuffer(b"".join(w.encode("latin-1").ljust(ROW + 1, b"\0") for w in words), np.uint8)
        return raw.reshape(len(words), ROW + 1)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of rows: are the words near? What they share from either end leaves one code point at most."""
        la, lb = self.lengths[a], self.lengths[b]
        out = (np.abs(la - lb) <= 1) & (a != b)
        at = np.flatnonzero(out)
        for lo in range(0, len(at), 1 << 15):
            k = at[lo : lo + (1 << 15)]
            x, y = a[k], b[k]
            most = np.maximum(la[k], lb[k])
            head = (self.left[x] != self.left[y]).argmax(1)
            tail = (self.right[x] != self.right[y]).argmax(1)
            out[k] = head + tail >= most - 1
            for q in np.flatnonzero(most > ROW):
                out[k[q]] = near(self.words[x[q]], self.words[y[q]])
        return out


class Trie:
    """Words by their counts from level ``start`` on, ``STEP`` levels to a step: the prefixes of each step in order."""

    def __init__(self, counts: np.ndarray, start: int):
        self.cuts = [*range(start, counts.shape[1], STEP), counts.shape[1]]
        #: the words (numbers of rows) in trie order, and for each step the numbers of the prefixes that occur
        self.order = np.lexsort(counts[:, start:].T[::-1]) if start < counts.shape[1] else np.arange(len(counts))
        node, self.steps = np.zeros(len(counts), np.int64), []
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            keys = (node << BITS * STEP) + packed(counts[:, lo:hi])
            known, node = np.unique(keys, return_inverse=True)
            self.steps.append(known)
        self.first = np.searchsorted(node[self.order], np.arange(node.max() + 2))

    def near(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) of which the budget left to the query reaches the word's leaf, depth first by blocks."""
        rows = np.arange(len(counts))
        stack = [(0, q, np.zeros(len(q), np.int64), s, d) for s in (0, 1) for d in (0, 1) for q in (rows[(surplus == s) & (deficit == d)],) if len(q)]
        while stack:
            step, q, node, s, d = stack.pop()
            if len(q) > 1 << 14:
                stack += [(step, q[k : k + (1 << 14)], node[k : k + (1 << 14)], s, d) for k in range(0, len(q), 1 << 14)]
                continue
            if step == len(self.steps):
                count = self.first[node + 1] - self.first[node]
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[node], count)
                yield np.repeat(q, count), self.order[place]
                continue
            known, part = self.steps[step], counts[q, self.cuts[step] : self.cuts[step + 1]]
            for up, less in moves(part.shape[1], s, d):
                able, to = moved(part, up, less)
                keys = (node[able] << BITS * STEP) + to
                child = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                there = np.flatnonzero(known[child] == keys)
                if len(there):
                    stack.append((step + 1, q[able[there]], child[there], s - (up >= 0), d - (less >= 0)))


def counted(docs: DataFrame, drop_one_in: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """``word, n``: the distinct words of ``docs`` (doc_id, text) with ``least`` occurrences and ``shortest`` code points.

    A run whose hash with its doc_id is divisible by ``drop_one_in`` loses one code point (0: none does)."""

    run_of = re.compile(f"[a-zÀ-ÿ]{{{max(shortest, 1)},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                text = (batch.column(1)[k].as_py() or "").encode().translate(LOWER).decode()
                doc = batch.column(0)[k].as_py()
                stem = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for run, n in Counter(run_of.findall(text)).items():
                    h = zlib.crc32(run.encode(), stem)
                    if drop_one_in and h % drop_one_in == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1 :]
                        if len(run) < shortest:
                            continue
                    total[run] += n
                if len(total) > HELD:
                    yield passed()
        if total:
            yield passed()

    parts = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(word: str) -> list[str]:
    """Names of the word's first and last half as the shorter and as the longer of a pair (of ``m`` code points at least).

    One edit leaves the first m // 2 or the last m - m // 2 code points of both alone."""
    return [f"{m}{kind}{half}" for m in (len(word), len(word) - 1) for kind, half in (("p", word[: m // 2]), ("s", word[len(word) - (m - m // 2) :]))]


def _meets(half: str, a: str, b: str) -> bool:
    """Is this the one half by which a pair is compared?"""
    m = min(len(a), len(b))
    return half.startswith(f"{m}p") or (half.startswith(f"{m}s") and a[: m // 2] != b[: m // 2])


def _depth(words: DataFrame, most: int) -> tuple[int, bool]:
    """The least number of levels whose subtrees hold at most ``most`` words, and whether all levels are too few."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors(batch.column(0).to_pylist())
            for levels in DEPTHS if len(counts) else ():
                keys, n = np.unique(packed(counts[:, :levels]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), levels, np.int32)), pa.array(keys), pa.array(n)], ["levels", "subtree", "n"])
    sizes = words.select("word").mapInArrow(prefixes, "levels int, subtree long, n long").groupBy("levels", "subtree").agg(F.sum("n").alias("n"))
    largest = {r["levels"]: r["n"] for r in sizes.groupBy("levels").agg(F.max("n").alias("n")).collect()}  # a row for each depth
    fit = [levels for levels in DEPTHS if largest.get(levels, 0) <= most]
    return (fit[0], False) if fit else (DEPTHS[-1], True)


#: A word as it is sent to a subtree: what is left of its budget there, and whether the subtree is its own.
DEALT = {"subtree": "long", "half": "string", "word": "string", "n": "long", "surplus": "byte", "deficit": "byte", "stored": "boolean"}


def neighbours(words: DataFrame, most: int = MOST) -> DataFrame:
    """``word, n_near, near_n, near``: for each word of ``words`` (word, n) that has near words their number, and the one
    with the largest n (ties: the smallest)."""
    levels, halves = _depth(words, most)
    ahead = [(up, less) for up, less in moves(levels, 1, 1) if up >= 0 and (less < 0 or up < less)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                words, n = (c.slice(lo, 2_000) for c in batch.columns)
                names = words.to_pylist()
                counts = vectors(names)[:, :levels]
                for up, less in [(-1, -1), *ahead]:
                    rows, to = moved(counts, up, less)
                    half = pa.nulls(len(rows), pa.string())
                    if halves:
                        each = [[*dict.fromkeys(_halves(names[k]))] for k in rows]
                        times = [len(x) for x in each]
                        rows, to, half = np.repeat(rows, times), np.repeat(to, times), pa.array([h for x in each for h in x], pa.string())
                    left = (pa.array(np.full(len(rows), x, np.int8)) for x in (up < 0, less < 0))
                    own = pa.array(np.full(len(rows), up < 0))
                    yield pa.RecordBatch.from_arrays([pa.array(to), half, words.take(pa.array(rows)), n.take(pa.array(rows)), *left, own], [*DEALT])

    def search(table: pa.Table) -> pa.Table:
        names, n, surplus, deficit = table.column("word").to_pylist(), *(table.column(c).to_numpy() for c in ("n", "surplus", "deficit"))
        half, stored = table.column("half")[0].as_py(), np.flatnonzero(table.column("stored").to_numpy())
        place = np.zeros(len(names), np.int64)
        place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        own = np.zeros(len(names), bool)
        own[stored] = True
        pairs = [np.zeros((2, 0), np.int64)]
        if len(stored):
            counts, rows = vectors(names), Words(names)
            for q, k in Trie(counts[stored], levels).near(counts, surplus, deficit):
                other = stored[k]
                once = ~own[q] | (place[q] < place[other])
                q, other = q[once], other[once]
                close = rows.near(q, other)
                pairs.append(np.stack([q[close], other[close]]))
        q, other = np.concatenate(pairs, axis=1)
        if half is not None:
            met = np.fromiter((_meets(half, names[x], names[y]) for x, y in zip(q, other, strict=True)), bool, len(q))
            q, other = q[met], other[met]
        word, other = np.concatenate([q, other]), np.concatenate([other, q])
        order = np.lexsort((place[other], -n[other], word))
        word, other = word[order], other[order]
        of, first, n_near = np.unique(word, return_index=True, return_counts=True)
        text = pa.array(names, pa.string())
        columns = [text.take(pa.array(of)), pa.array(n_near), pa.array(n[other[first]]), text.take(pa.array(other[first]))]
        return pa.table(columns, names=["word", "n_near", "near_n", "near"])

    dealt = words.select("word", "n").mapInArrow(deal, ", ".join(map(" ".join, DEALT.items())))
    parts = dealt.groupBy("subtree", "half").applyInArrow(search, "word string, n_near long, near_n long, near string")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    whole = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return whole.select("word", "n_near", (-F.col("first.less")).alias("near_n"), F.col("first.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for (word, form): the last form that following forms leads to. Each round doubles the steps."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = saved(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.where("moved").head(1):
            return now


def variants(docs: DataFrame, times: int = 10, most: int = MOST, **counting: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the counted words of ``docs``.

    A word's form is its near word of largest n, if that is ``times`` its own n or more; forms rise in n, so that no
    chain of them returns."""
    with scratch() as kept:
        words = saved(counted(docs, **counting), "words")
        found = words.join(neighbours(words, most), "word", "left")
        fits = F.col("near_n") >= times * F.col("n")
        found = saved(found.select("word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n")), "variants")
        ends = saved(roots(found.where("form is not null")), "ends")
        kept += [found, ends]
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
