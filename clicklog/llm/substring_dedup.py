"""Substring dedup by suffix automata of reference shards: words in a window that starts in an earlier document go.

A window is ``width`` consecutive words. A word is removed if it lies in a window of its document that also starts in a
document with a smaller doc_id. Whether it does is decided by suffix automata over words, whose states carry the first
document of their strings: passages are streamed through a shard's automaton, the match's length is kept word by word,
and where it reaches ``width`` the state of the last ``width`` words names the window's first document.

All documents are reference, so a shard cannot go to every task: it is sent what it can meet. Each window is known
by its least hash of ``gram`` consecutive words; hashes that one document alone has are dropped, and of the other windows
neighbours with the same hash make a passage. Equal texts are one, with their first document: all windows of the others start there.
Equal passages are one, too. A shard holds all
passages of its hashes, about SHARD words, builds its automaton over them and streams them through it. A hash with more
than HOT passages is parted by window instead. What the shard found goes back to the documents by passage.

Nulls: a null text has no words; a document with a null doc_id keeps its words and is no reference. Empty texts and texts
of fewer than ``width`` words keep theirs. Rows with equal doc_id remove nothing from each other; each has its own text's
result. Very long texts are read whole. Repeated windows inside a document are no reason to remove them. An empty table
gives an empty result. Other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklog.llm import words as W
from clicklog.llm.store import dropped, saved, scratch

WORD = re.compile(r"[^ \t-\r]+")
WIDTH, GRAM = 13, 5
#: Words of the passages of a shard, on average.
SHARD = 100_000
#: Passages of one hash that a shard takes whole.
HOT = 2_000
#: Keys of up to so many rows or groups of equal texts are broadcast, so that other texts are not shuffled.
BROADCAST_MOST = 1_000_000


class Automaton:
    """Suffix automaton of sequences of words; added in the order of their documents, each state has its first document."""

    def __init__(self) -> None:
        self.goes: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, goes: dict[str, int], link: int, length: int, first: int | None) -> int:
        self.goes.append(goes), self.link.append(link), self.length.append(length), self.first.append(first)
        return len(self.goes) - 1

    def _parted(self, at: int, word: str, to: int) -> int:
        """The state of the strings of ``to`` that end an occurrence of ``at``'s longest and ``word``."""
        goes, link, length = self.goes, self.link, self.length
        if length[to] == length[at] + 1:
            return to
        copy = self._state(dict(goes[to]), link[to], length[at] + 1, self.first[to])
        link[to] = copy
        while at >= 0 and goes[at].get(word) == to:
            goes[at][word] = copy
            at = link[at]
        return copy

    def add(self, words: list[str], doc: int) -> None:
        goes, link, length, last = self.goes, self.link, self.length, 0
        for word in words:
            to = goes[last].get(word)
            if to is not None:  # known from an earlier sequence
                last = self._parted(last, word, to)
                continue
            new, at = self._state({}, 0, length[last] + 1, doc), last
            while at >= 0 and word not in goes[at]:
                goes[at][word] = new
                at = link[at]
            if at >= 0:
                link[new] = self._parted(at, word, goes[at][word])
            last = new

    def firsts(self, words: list[str], width: int) -> list[int | None]:
        """For each window of ``words`` the first document that has it, or none."""
        goes, link, length, state, match, out = self.goes, self.link, self.length, 0, 0, []
        for k, word in enumerate(words):
            while state and word not in goes[state]:
                state = link[state]
                match = length[state]
            if word in goes[state]:
                state, match = goes[state][word], match + 1
            found = None
            if match >= width:
                while length[link[state]] >= width:
                    state = link[state]
                match = min(match, length[state])
                found = self.first[state]
            if k >= width - 1:
                out.append(found)
        return out


def least_hashes(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's least hash of ``gram`` words; its row, its first word (of all rows' words), and where words start."""
    hashes, rows = W.word_hashes(data, offsets, W.EXACT)
    starts, _ = W.word_starts(data, offsets)
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, starts
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for j in range(gram):
        grams = W.mix(grams + hashes[j : len(hashes) - gram + 1 + j], 0x9E3779B97F4A7C15)
    least, have, want = grams, 1, width - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = np.flatnonzero(row[:n] == row[width - 1 :])
    return least[whole], row[whole], whole, starts


def _changes(*values: np.ndarray) -> np.ndarray:
    """Places at which one of the values differs from the one before."""
    new = np.ones(len(values[0]), bool)
    if len(new):
        new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    return np.flatnonzero(new)


def _hashed(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``h, doc``: the windows' least hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.chunks(batch.column("text")):
                h, row, _, _ = least_hashes(data, offsets, width, gram)
                k = _changes(h, row)
                yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), batch.column("doc").take(pa.array(row[k] + at))], ["h", "doc"])

    return docs.select("doc", "text").mapInArrow(scan, "h long, doc long")


def _passages(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """``h, doc, t, start, n, words``: stretches of at most width - gram + 1 windows whose least hash is one of the row's ``hs``."""
    most = width - gram + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("hs")
            for at, data, offsets in W.chunks(batch.column("text")):
                h, row, first, starts = least_hashes(data, offsets, width, gram)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                shared = np.zeros(len(h), bool)
                for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    known = np.sort(wanted[at + r].values.to_numpy(zero_copy_only=False))
                    shared[a:b] = known[np.minimum(np.searchsorted(known, h[a:b].view(np.int64)), len(known) - 1)] == h[a:b].view(np.int64)
                h, row, first = h[shared], row[shared], first[shared]
                new = _changes(h, row, first - np.arange(len(first)))
                run = np.repeat(new, np.diff(new, append=len(h)))
                new = np.flatnonzero((np.arange(len(h)) - run) % most == 0)
                n = np.diff(new, append=len(h))
                # bytes up to where the next word, or the row, starts
                ends = np.minimum(np.append(starts, len(data))[np.minimum(first[new] + n - 1 + width, len(starts))], offsets[row[new] + 1])
                raw = data.tobytes()
                text = [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends.tolist(), strict=True)]
                begins = np.searchsorted(starts, offsets[:-1])[row[new]]
                own = pa.array(row[new] + at)
                columns = [pa.array(h[new].view(np.int64)), batch.column("doc").take(own), batch.column("t").take(own), pa.array((first[new] - begins).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc", "t", "start", "n", "words"])

    return docs.select("doc", "t", "text", "hs").mapInArrow(cut, "h long, doc long, t long, start int, n int, words string")


def _windows(passages: DataFrame, width: int) -> DataFrame:
    """Each window of the passages as a piece of its own, numbered."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                pieces = [(k, i, " ".join(w[i : i + width])) for k, w in enumerate(map(WORD.findall, some.column("words").to_pylist())) for i in range(len(w) - width + 1)]
                at = pa.array([p[0] for p in pieces], pa.int64())
                columns = [some.column(c).take(at) for c in ("h", "x", "doc")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.string())], ["h", "x", "doc", "no", "words"])

    return passages.select("h", "x", "doc", "words").mapInArrow(part, "h long, x long, doc long, no int, words string")


def first_documents(passages: DataFrame, width: int = WIDTH, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``h, x, firsts`` for distinct passages (h, x, doc, n, words): for each window of a passage the first document that
    has it in a passage of the same hash. ``doc`` is the passage's own first document."""

    def search(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc").to_numpy(), kind="stable")
        docs, text = table.column("doc").to_pylist(), [WORD.findall(x) for x in table.column("words").to_pylist()]
        automaton = Automaton()
        for k in order.tolist():
            automaton.add(text[k], docs[k])
        found = [automaton.firsts(w, width) for w in text]
        return pa.table([table.column("h"), table.column("p"), pa.array(found, pa.list_(pa.int64()))], names=["h", "p", "firsts"])

    total = passages.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    shards = F.lit(max(1, -(-total // shard)))
    many = passages.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("h")
    whole = passages.join(many, "h", "left_anti").select("h", F.col("x").alias("p"), "doc", "words", F.pmod(F.xxhash64("h"), shards).alias("shard"))
    pieces = saved(_windows(passages.join(many, "h", "left_semi"), width).withColumn("p", F.xxhash64("words")), "pieces")
    parted = pieces.groupBy("h", "p").agg(F.min("doc").alias("doc"), F.min("words").alias("words"))
    parted = parted.select("h", "p", "doc", "words", F.pmod(F.xxhash64("h", "p"), shards).alias("shard"))
    found = saved(whole.union(parted).groupBy("shard").applyInArrow(search, "h long, p long, firsts array<long>"), "firsts")
    again = pieces.select("h", "x", "no", "p").join(found, ["h", "p"])
    again = again.groupBy("h", "x").agg(F.sort_array(F.collect_list(F.struct("no", "firsts"))).alias("all"))  # a passage's few windows
    return found.join(many, "h", "left_anti").select("h", F.col("p").alias("x"), "firsts").union(again.select("h", "x", F.flatten("all.firsts")))


def few(keys: DataFrame) -> DataFrame | None:
    """Keys (a few numbers each) as a broadcast, if they are BROADCAST_MOST at most."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_MOST else None


def with_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc, t, text) with ``copy``: does a document with a smaller doc have the same text? And the table that it reads."""
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    named = docs.where("doc is not null and text is not null").select("doc", digest)
    first = saved(named.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digest", "first"), "copies")
    small = few(first)
    told = docs.withColumn("digest", digest).join(first if small is None else small, "digest", "left")
    return told.select("doc", "t", "text", F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).alias("copy")), first


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``doc, t, starts`` for the rows of ``docs`` (doc, t, text) with windows that an earlier document has: their first words."""
    with scratch() as kept:
        rows = docs.where("doc is not null and text is not null")
        hashed = saved(_hashed(rows, width, gram), "hashes")
        shared = hashed.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("h")
        of_doc = saved(hashed.join(shared, "h", "left_semi").groupBy("doc").agg(F.collect_set("h").alias("hs")), "of_doc")  # of one document
        dropped(hashed)
        ids = few(of_doc.select("doc"))
        wanted = rows if ids is None else rows.join(ids, "doc", "left_semi")
        passages = saved(_passages(wanted.join(of_doc, "doc"), width, gram).withColumn("x", F.xxhash64("words")), "passages")
        distinct = passages.groupBy("h", "x").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("words").alias("words"))
        found = first_documents(saved(distinct, "distinct"), width, shard, hot)
        met = passages.select("h", "x", "doc", "t", "start").join(found, ["h", "x"])
        earlier = F.expr("filter(transform(firsts, (f, i) -> if(f < doc, start + i, null)), s -> s is not null)")
        met = met.select("doc", "t", earlier.alias("starts")).where(F.size("starts") > 0)
        out = saved(met.groupBy("doc", "t").agg(F.flatten(F.collect_list("starts")).alias("starts")), "repeats")  # of one text
        kept.append(out)
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs`` (doc_id, text); ``kept`` holds the words that stay, joined
    by one space."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some, out = batch.slice(lo, 256), []
                for text, copy, starts in zip(some.column("text").to_pylist(), some.column("copy").to_pylist(), some.column("starts"), strict=True):
                    words = WORD.findall(text or "")
                    n = len(words)
                    if copy and n >= width:
                        words = []
                    elif starts.is_valid:
                        edge = np.zeros(n + 1, np.int64)
                        places = np.unique(starts.values.to_numpy(zero_copy_only=False))
                        edge[places] += 1
                        edge[places + width] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    out.append((n, n - len(words), " ".join(words)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc"), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    with scratch() as kept:
        rows, copies = with_copies(docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("t"), "text"))
        kept.append(copies)
        found = repeats(rows.where("not copy").select("doc", "t", "text"), width, gram, shard, hot)
        kept.append(found)
        key = ["doc", "t"]
        ids = few(found.select(*key))
        if ids is None:
            whole = rows.join(found, key, "left")
        else:
            untouched = rows.join(ids, key, "left_anti").withColumn("starts", F.lit(None).cast("array<int>"))
            whole = rows.join(ids, key, "left_semi").join(found, key).unionByName(untouched)
    return whole.select("doc", "text", "copy", "starts").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
