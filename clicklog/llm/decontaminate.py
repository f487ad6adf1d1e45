"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words, over all documents, give the weights (IDF).
2. Passages are dealt into groups of at most GROUP and GROUP_WORDS words. A randomised SVD of each group's TF-IDF vectors (a task a group)
   gives its latent space, which holds all of its passages, as its rank is above GROUP.
3. A document that holds a passage has, by count, at least one of its rarest words: of n words of which m must be
   there, one of the n - m + 1 rarest. Around each such word the text is folded into the passage's latent space. Its
   product with the passage, and the most that the parts outside the space can add, must reach the least weight that
   an accepted text shares with the passage. Both bounds follow from the rule below, so that they lose nothing.
4. Candidates are checked exactly around the word: the longest common subsequence of words with the passage, and,
   for paraphrases, whether the passage's answer (its closing words) is there.

A document is contaminated by an item if the common subsequence covers NEAR of the item's words, or PARAPHRASE of
them and ANSWER of the answer's words, in a stretch of text that goes the item's length beyond each side of two blocks of
BLOCK words. ``cosine`` is that of the stretch and the passage in the latent space.

Passages are read in blocks of about ITEMS or BYTES, each broadcast with its latent matrices; more passages mean more passes
over the documents. Case is ignored. Nulls: a null text or item has no words and matches nothing; items of fewer than LEAST_WORDS
words must occur whole, as a phrase. A null doc_id or item_id is kept as it is. Very long texts are searched whole, repeated
rows each give their own result rows, empty tables an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicklog.llm import words
from clicklog.llm.store import spare

FEATURES = 1 << 18
SLICE = 1 << 13
BLOCK = 24
RANK, OVERSAMPLE = 192, 32
NEAR, PARAPHRASE, ANSWER, ANSWER_WORDS = 0.8, 0.5, 0.8, 8
LEAST_WORDS = 8
#: Items and words of a group (a longer item is a group of its own), items and bytes of a block (on average).
GROUP, GROUP_WORDS = 150, 1 << 14
ITEMS, BYTES = 5_000, 8_000_000


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % FEATURES


def _plain(data: np.ndarray) -> np.ndarray:
    """ASCII punctuation counts as white space, so that added marks do not hide a word."""
    return _PLAIN[data]


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each hashed word the number of texts that have it, and the number of texts; both over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, data, offsets in words.chunks(batch.column("text")):
                hashes, rows = words.word_hashes(_plain(data), offsets)
                pairs = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(rows)) * FEATURES + _features(hashes))
                seen += np.bincount(pairs % FEATURES, minlength=FEATURES)
        parts = [seen[i : i + SLICE].tobytes() for i in range(0, FEATURES, SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(parts))], pa.int32()), pa.array([np.int64(total).tobytes(), *parts], pa.binary())], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    got = texts.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    found = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in got}
    if not found:
        return np.zeros(FEATURES, np.int64), 0
    return np.concatenate([found[i] for i in range(FEATURES // SLICE)]), int(found[-1][0])


@dataclass
class Latent:
    """The latent space of one group of items."""

    features: np.ndarray  # ascending
    space: np.ndarray  # features x rank
    folded: np.ndarray  # items x rank
    outside: np.ndarray  # length of each item's part outside the space


@dataclass
class Passages:
    """One block of benchmark items: their words, the words that bring them up, and their groups' latent spaces."""

    ids: list[int | None]
    tokens: list[np.ndarray]
    idf: np.ndarray
    bounds: np.ndarray  # of each feature in ``items``
    items: np.ndarray  # that a feature brings up
    least: np.ndarray  # product with the item's unit vector that an accepted text has at least
    groups: list[Latent]
    places: list[tuple[int, int]]  # each item's group, and its row there


def _tfidf(features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, tf = np.unique(features, return_counts=True)
    value = tf * idf[at]
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


def latent_space(rows: list[tuple[np.ndarray, np.ndarray]], rank: int = RANK, seed: int = 11) -> Latent:
    """The span of the leading right singular vectors of the items' TF-IDF rows, given as (features, values).

    A' A Omega on the features that occur is orthonormalised; the Gram matrix of the items in that basis has the
    eigenvectors that orient it.
    """
    features = np.unique(np.concatenate([f for f, _ in rows]))
    whole = np.zeros((len(rows), len(features)))
    for i, (f, v) in enumerate(rows):
        whole[i, np.searchsorted(features, f)] = v
    k = min(rank + OVERSAMPLE, len(features), len(rows) + OVERSAMPLE)
    bits = words.mix(features.astype(np.uint64)[:, None] * np.uint64(k + 1) + np.arange(k, dtype=np.uint64), seed)
    basis, _ = np.linalg.qr(whole.T @ (whole @ np.where(bits & np.uint64(1), 1.0, -1.0)))
    inside = whole @ basis
    values, vectors = np.linalg.eigh(inside.T @ inside)
    lead = np.argsort(-values)[:rank]
    space = (basis @ vectors[:, lead[values[lead] > 1e-9]]).astype(np.float32)
    folded = whole @ space
    return Latent(features, space, folded, np.linalg.norm(whole - folded @ space.T, axis=1))


def needed(share: float, n: int) -> int:
    """The least count whose quotient by ``n`` is ``share`` or more."""
    return next(m for m in range(n + 1) if m / n >= share)


def bounds_of(item: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """Features of which an accepted text has at least one, and the least product it has with the item's unit vector."""
    features = _features(item)
    rare = features[np.argsort(-idf[features], kind="stable")]
    kept = needed(1.0 if len(item) < LEAST_WORDS else NEAR, len(item))
    answer = _features(np.unique(item[-ANSWER_WORDS:]))
    answer = answer[np.argsort(-idf[answer], kind="stable")]
    some, reply = needed(PARAPHRASE, len(item)), needed(ANSWER, len(answer))
    bring, weight = rare[: len(item) - kept + 1], (idf[rare[-kept:]] ** 2).sum()
    if len(item) >= LEAST_WORDS:
        bring = np.concatenate([bring, answer[: len(answer) - reply + 1]])
        weight = min(weight, max((idf[rare[-some:]] ** 2).sum(), (idf[np.unique(answer[-reply:])] ** 2).sum()))
    _, tf = np.unique(features, return_counts=True)
    return np.unique(bring), float(weight / np.sqrt(((tf * idf[np.unique(features)]) ** 2).sum()))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer (a column of the table at a time)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def is_phrase(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether the item's words stand side by side in the text."""
    if len(text) < len(item):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(text, len(item)) == item).all(1).any())


def matches(p: Passages, text: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """``(row, item, lcs, answer, cosine)`` for the texts that hold an item."""
    many = np.diff(p.bounds)
    answers = [frozenset(t[-ANSWER_WORDS:].tolist()) for t in p.tokens]
    for first, data, offsets in words.chunks(text):
        hashes, bounds = words.word_hashes(_plain(data), offsets)
        if not len(hashes):
            continue
        features = _features(hashes)
        hit = np.flatnonzero(many[features])
        doc = np.searchsorted(bounds, hit, side="right") - 1
        start = hit - (hit - bounds[doc]) % BLOCK
        times = many[features[hit]]
        item = p.items[np.repeat(p.bounds[features[hit]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        # each block that has a word of an item, once
        pairs = np.unique(np.repeat(start, times) * len(p.ids) + item)
        start, items = pairs // len(p.ids), pairs % len(p.ids)
        doc = np.searchsorted(bounds, start, side="right") - 1
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for a, d, j in zip(start.tolist(), doc.tolist(), items.tolist(), strict=True):
            item, (group, k) = p.tokens[j], p.places[j]
            group = p.groups[group]
            low, high = max(bounds[d], a - len(item)), min(bounds[d + 1], a + 2 * BLOCK + len(item))
            near = features[low:high]
            at = np.minimum(np.searchsorted(group.features, near), len(group.features) - 1)
            known = group.features[at] == near
            fold = p.idf[near[known]] @ group.space[at[known]]
            product = float(fold @ group.folded[k])
            # what the text and the item have outside the space adds at most the product of their lengths
            length = (np.bincount(at[known]) * p.idf[group.features[: at[known].max(initial=-1) + 1]]) if group.outside[k] > 1e-3 else fold
            beyond = np.sqrt(max(float(length @ length - fold @ fold), 0.0)) * float(group.outside[k])
            if (product + beyond) * (1 + 1e-3) + 1e-3 < p.least[j]:
                continue
            around = hashes[low:high]
            if len(item) < LEAST_WORDS:
                common = reply = float(is_phrase(item, around))
                held = common == 1
            else:
                common = common_subsequence(item, around) / len(item)
                reply = len(answers[j] & set(around.tolist())) / len(answers[j])
                held = common >= NEAR or (common >= PARAPHRASE and reply >= ANSWER)
            if held:
                at, tf = np.unique(near, return_counts=True)
                cosine = product / max(np.linalg.norm(tf * p.idf[at]) * np.linalg.norm(group.folded[k]), 1e-12)
                best[first + d, j] = max(best.get((first + d, j), (0.0, 0.0, 0.0)), (common, reply, float(cosine)))
        yield from ((*key, *value) for key, value in best.items())


def blocks_of(docs: DataFrame, benchmark: DataFrame, items_a_block: int = ITEMS, rank: int = RANK) -> Iterator:
    """Broadcasts of :class:`Passages`, one for each block of the benchmark."""
    spark = docs.sparkSession
    seen, total = document_frequencies(docs.select(F.lower("text").alias("text")))
    idf = np.log((1 + total) / (1 + seen)) + 0.1
    size = benchmark.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // items_a_block), -(-(size["b"] or 0) // BYTES))
    split = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        items = split.where((F.col("_block") == block) & F.col("text").isNotNull()).drop("_block")
        rows = items.orderBy("item_id", "text").collect()  # a block of about items_a_block
        tokens = []
        for _, data, offsets in words.chunks(pa.array([r["text"] for r in rows], pa.large_string())):
            hashes, bounds = words.word_hashes(_plain(data), offsets)
            tokens += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        keep = [i for i, t in enumerate(tokens) if len(t)]
        if not keep:
            continue
        vectors = [_tfidf(_features(tokens[i]), idf) for i in keep]
        groups, places, held = [], [], 0
        for i, v in zip(keep, vectors, strict=True):
            if not groups or len(groups[-1]) == GROUP or held + len(tokens[i]) > GROUP_WORDS:
                groups.append([])
                held = 0
            places.append((len(groups) - 1, len(groups[-1])))
            groups[-1].append(v)
            held += len(tokens[i])
        groups = spark.sparkContext.parallelize(groups, len(groups)).map(lambda g: latent_space(g, rank)).collect()
        bring, least = zip(*(bounds_of(tokens[i], idf) for i in keep), strict=True)
        feature, item = np.concatenate(bring), np.repeat(np.arange(len(keep)), [len(b) for b in bring])
        order = np.argsort(feature, kind="stable")
        bounds = np.searchsorted(feature[order], np.arange(FEATURES + 1))
        yield spark.sparkContext.broadcast(Passages([rows[i]["item_id"] for i in keep], [tokens[i] for i in keep], idf, bounds, item[order], np.array(least), groups, places))


def contaminated(docs: DataFrame, benchmark: DataFrame, items_a_block: int = ITEMS, rank: int = RANK) -> DataFrame:
    """``doc_id, item_id, lcs, answer, cosine`` for each document that holds a benchmark item, exactly or paraphrased."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    schema, names = "doc_id long, item_id long, lcs double, answer double, cosine double", ["doc_id", "item_id", "lcs", "answer", "cosine"]

    def search(passages, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := list(matches(passages.value, batch.column("text"))):
                row, item, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([passages.value.ids[j] for j in item], pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], names)

    result = docs.sparkSession.createDataFrame([], schema)
    for passages in blocks_of(docs, benchmark, items_a_block, rank):
        result = result.union(docs.mapInArrow(lambda b, passages=passages: search(passages, b), schema))
    return result


def clean(docs: DataFrame, benchmark: DataFrame, items_a_block: int = ITEMS, rank: int = RANK) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with their columns; rows are dropped where they are read."""

    def kept(passages, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, bool)
            stays[[m[0] for m in matches(passages.value, batch.column(lower))]] = False
            yield batch.select(names).filter(pa.array(stays))

    names, lower = docs.columns, spare(docs.columns, "lower")

    for passages in blocks_of(docs, benchmark, items_a_block, rank):
        docs = docs.withColumn(lower, F.lower("text")).mapInArrow(lambda b, passages=passages: kept(passages, b), docs.schema)
    return docs
