"""Toxicity by a classifier chain over hashed words.

The chain predicts categories one after another; each is a logistic regression on hashed words and on the
probabilities of the categories before it. For training those are out-of-fold predictions, so that a later model
does not learn from its inputs' own labels. The last category is what is judged: abuse at all, after junk, and
abuse within ordinary prose. Its threshold comes from its own out-of-fold predictions.

Words are runs of letters (bytes of A-Z, a-z and 128-255), A-Z lower-cased, so that marks around or inside a word do
not hide it. A text's columns hold 1 for each hashed word, and for each beginning of a word, that it has (presence, not
share: one abusive word in a very long text counts in full). The regressions are fitted on the columns that mark a
category best: KEPT of them at most for the last category, KEPT_EARLIER for each earlier one, all LEAST_LIFT times as
frequent with its label as without, at a z-score of LEAST_Z or more, from a bounded sample of labelled rows.

Nulls: a null text has no words and is judged as an empty one. Null labels are ignored; of repeated labels of a
document the greatest counts. Very long texts are read whole; repeated rows get equal answers; without positive
rows a category's probability is 0. An empty table gives an empty result. Other columns are kept, those named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklog.llm import words

FEATURES = 1 << 20
KEPT, KEPT_EARLIER, LEAST_Z, LEAST_LIFT = 256, 64, 4.0, 5.0
PREFIXES = (4, 5)
#: Labelled rows with and without the last category, of the least hash, that are learned from.
SAMPLE = 3000
FOLDS = 5
SLACK = 0.002
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(97, 123), *range(128, 256)]


def categories() -> dict[str, Column]:
    """In the order of the chain, over the columns of ``labels``: junk, abuse within ordinary prose, abuse at all."""
    toxic, junk = F.col("toxic") == 1, F.col("quality") == 0
    return {"junk": junk, "toxic_prose": toxic & ~F.coalesce(junk, F.lit(False)), "toxic": toxic}


def present(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the hashed words and their first PREFIXES bytes, and each row's bounds in them."""
    for _, data, offsets in words.chunks(text):
        data = _LETTERS[data]
        hashes, rows = words.word_hashes(data, offsets)
        starts, _ = words.word_starts(data, offsets)
        found = [hashes]
        for length in PREFIXES:
            start, code = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
            for k in range(length):
                at = np.minimum(starts + k, max(len(data) - 1, 0))
                code &= (starts + k < len(data)) & ~words.SPACE[data[at]]
                start = start * np.uint64(257) + np.where(code, data[at], 0).astype(np.uint64)
            found.append(words.mix(start, length))
        yield (np.column_stack(found).ravel() >> np.uint64(44)).astype(np.int64) % FEATURES, rows * len(found)


@dataclass
class Chain:
    names: list[str]
    column: np.ndarray  # of a hashed word, -1 for those not kept
    weights: list[np.ndarray]  # kept words, then earlier categories, then the intercept
    threshold: float

    def probabilities(self, text: pa.Array) -> np.ndarray:
        out, width = [np.zeros((0, len(self.names)))], len(self.weights[0]) - 1
        for features, rows in present(text):
            n = len(rows) - 1
            column = self.column[features]
            doc = np.repeat(np.arange(n), np.diff(rows))[column >= 0]
            pairs = np.unique(doc * max(width, 1) + column[column >= 0])
            doc, column = pairs // max(width, 1), pairs % max(width, 1)
            p = np.zeros((n, len(self.names)))
            for k, w in enumerate(self.weights):
                z = np.bincount(doc, w[column], n) + p[:, :k] @ w[width : width + k] + w[-1]
                p[:, k] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            out.append(p)
        return np.concatenate(out)


def regression(x: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 1.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by full gradient steps with momentum; both labels weigh the same in all."""
    w, speed = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    if not y.any():
        w[-1] = -50
        return w
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        speed = 0.9 * speed - (x.T @ ((p - y) * weight) + decay * np.append(w[:-1], 0))
        w += rate * speed
    return w


def fit(rows: list[np.ndarray], y: np.ndarray, names: list[str], folds: int = FOLDS, seed: int = 7) -> Chain:
    """``rows``: the hashed words of each labelled text; ``y``: a column of labels for each category."""
    # near copies of one text would make its chance words look telling: of texts with equal min-hashes one is used
    first = {tuple(int(words.mix(r.astype(np.uint64), salt).min(initial=2**64 - 1)) for salt in (1, 2, 3)): i for i, r in reversed(list(enumerate(rows)))}
    used = sorted(first.values())
    rows, y = [rows[i] for i in used], y[used]
    n = len(rows)
    flat, doc = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    chosen: list[np.ndarray] = []
    for k in range(y.shape[1]):
        label = y[:, k] == 1
        with_, without = np.bincount(flat[label[doc]], minlength=FEATURES), np.bincount(flat[~label[doc]], minlength=FEATURES)
        n1, n0 = max(label.sum(), 1), max((~label).sum(), 1)
        both = np.minimum((with_ + without) / n, 1)
        z = (with_ / n1 - without / n0) / np.sqrt(np.maximum(both * (1 - both) * (1 / n1 + 1 / n0), 1e-12))
        z[(with_ < 2) | (with_ / n1 < LEAST_LIFT * without / n0)] = 0
        best = np.argsort(-z, kind="stable")[: KEPT if k == y.shape[1] - 1 else KEPT_EARLIER]
        chosen.append(best[z[best] >= LEAST_Z])
    kept = np.unique(np.concatenate(chosen))
    column = np.full(FEATURES, -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((n, len(kept)))
    x[doc[column[flat] >= 0], column[flat][column[flat] >= 0]] = 1
    fold = np.random.default_rng(seed).permutation(n) % folds
    out, weights = np.zeros((n, 0)), []
    for k in range(y.shape[1]):
        inputs = np.column_stack([x, out])
        weights.append(regression(inputs, y[:, k]))
        held = np.zeros(n)
        for f in range(folds):
            w = regression(inputs[fold != f], y[fold != f, k])
            held[fold == f] = 1 / (1 + np.exp(-np.clip(inputs[fold == f] @ w[:-1] + w[-1], -50, 50)))
        out = np.column_stack([out, held])
    # the last category's threshold: the least one whose out-of-fold F1 is within SLACK of the best
    last, label = out[:, -1], y[:, -1] == 1
    p = np.unique(np.concatenate([last, [0.0, 1.0]]))
    cuts = (p[1:] + p[:-1]) / 2
    f1 = np.array([2 * ((last >= c) & label).sum() / max(1, (last >= c).sum() + label.sum()) for c in cuts])
    threshold = float(cuts[np.flatnonzero(f1 >= f1.max() - SLACK)[0]])
    return Chain(names, column, weights, threshold)


def train(docs: DataFrame, labels: DataFrame, chain: dict[str, Column] | None = None, sample: int = SAMPLE) -> Chain | None:
    chain = categories() if chain is None else chain
    names = list(chain)
    ys = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in chain.items()]
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(*ys)
    least = [known.where(F.col(names[-1]) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for v in (0, 1)]
    chosen = F.broadcast(least[0].union(least[1]))  # 2 * sample documents at most

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(f[a:b]).astype("<i4").tobytes() for f, bounds in present(batch.column("text")) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.binary())], [*names, "x"])

    # of repeated rows of a document the one of least text is learned from
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    got = rows.select(*names, "text").mapInArrow(described, ", ".join(f"{c} int" for c in names) + ", x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: tuple(r))
    return fit([np.frombuffer(r["x"], "<i4").astype(np.int64) for r in got], np.array([[r[c] for c in names] for r in got]), names)


def judge(docs: DataFrame, chain: Chain | None, names: list[str] | None = None) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category of the chain, and ``is_toxic`` by the last one's threshold."""
    names = chain.names if chain else names or list(categories())
    extra = [*(f"p_{c}" for c in names), "is_toxic"]
    docs = docs.drop(*extra)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(batch.column("text")) if chain else np.zeros((batch.num_rows, len(names)))
            hit = p[:, -1] >= chain.threshold if chain else np.zeros(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k].copy()) for k in range(len(names))), pa.array(hit)], [*batch.schema.names, *extra])

    schema = T.StructType([*docs.schema.fields])
    for c in extra[:-1]:
        schema = schema.add(c, "double")
    return docs.mapInArrow(predict, schema.add("is_toxic", "boolean"))
