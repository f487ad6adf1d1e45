"""Language identification: averaged hashed subword embeddings with a linear softmax, calibrated to reject.

A text's vector is the mean of the embeddings of its byte 2-, 3- and 4-grams (A-Z lower-cased, white space as one
mark; only the outer bytes of an n-gram may be white space). Embeddings and softmax are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows (SAMPLE, chosen by hash). Part of the sample is held
back: it sets the softmax's temperature and the score below which a text is rejected.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Very long texts are read whole. A text with letters
always gets a learned language, and is rejected if its score is far below those of right answers (text of no learned
language, junk); with no labelled rows there is no language and every text is ``und``. Rows with equal doc_id, text
and lang are learned from once; repeated rows get equal answers; an empty table gives an empty result. Other columns are
kept, result names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklog.llm import words

BUCKETS, DIM = 1 << 13, 16
#: Labelled rows learned from in all, and of a language at least; the most frequent LANGUAGES are learned.
SAMPLE, LEAST, LANGUAGES = 2400, 24, 100
#: A text is rejected below this share of the score that all right ones but a REJECT_QUANTILE of those held back reach.
REJECT_QUANTILE, REJECT_SHARE = 0.002, 0.6
_CODE = np.where(words.SPACE, 0, words.LOWER).astype(np.uint64)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 2, 3, 4: the buckets of all n-grams that stay in a row, and each row's bounds in them."""
    code, space = _CODE[data], words.SPACE[data]
    rolled = code
    for n in (2, 3, 4):
        if len(code) < n:
            return
        rolled = rolled[:-1] * np.uint64(257) + code[n - 1 :]
        out = np.zeros(len(rolled), dtype=bool)
        for k in range(1, n - 1):
            out |= space[k : k + len(rolled)]
        if n == 2:
            out = space[:-1] & space[1:]
        for k in range(1, n):
            over = offsets[1:-1] - k
            out[over[(over >= 0) & (over < len(out))]] = True
        at = np.flatnonzero(~out)
        yield (words.mix(rolled[at], n) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(at, offsets)


def averages(text: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text the mean of ``table``'s rows (one for each bucket) over its subwords; zero without any."""
    out = [np.zeros((0, table.shape[1]))]
    for _, data, offsets in words.chunks(text):
        total, count = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
        for bucket, bounds in subwords(data, offsets):
            total += words.sums(table[bucket], bounds)
            count += np.diff(bounds)
        out.append(total / np.maximum(count, 1)[:, None])
    return np.concatenate(out)


def counted(text: pa.Array) -> np.ndarray:
    """Rows of subword shares, one column for each bucket."""
    out = [np.zeros((0, BUCKETS), np.float32)]
    for _, data, offsets in words.chunks(text):
        share = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
        for bucket, bounds in subwords(data, offsets):
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                share[i] += np.bincount(bucket[a:b], minlength=BUCKETS)
        out.append(share / np.maximum(share.sum(1, keepdims=True), 1))
    return np.concatenate(out)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    """``table``: logits of each subword (embedding times softmax weights); ``reject``: the least accepted score."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    reject: float

    def scores(self, text: pa.Array) -> np.ndarray:
        return softmax(averages(text, self.table) + self.bias)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 40, rate: float = 0.3, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    ge, gt = np.full_like(emb, 1e-6), np.full_like(top, 1e-6)  # step sizes by the gradients so far
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            xb = x[part]
            hidden = xb @ emb
            wrong = softmax(hidden @ top + bias)
            wrong[np.arange(len(part)), y[part]] -= 1
            wrong /= max(1, len(part))
            dt, de = hidden.T @ wrong, xb.T @ (wrong @ top.T)
            gt += dt * dt
            ge += de * de
            top -= rate * dt / np.sqrt(gt)
            emb -= rate * de / np.sqrt(ge)
            bias -= rate * wrong.sum(0)
    table, bias = (emb @ top).astype(float), bias.astype(float)
    check = held if len(held) else used
    logits = x[check] @ table + bias
    heat = min(np.geomspace(0.25, 8, 26), key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean())
    p = softmax(logits / heat)
    right = p.max(1)[p.argmax(1) == y[check]]
    # a text passes unless its score is well below nearly all right ones
    reject = REJECT_SHARE * float(np.quantile(right, REJECT_QUANTILE)) if len(right) else 0.0
    return Model(langs, table / heat, bias / heat, reject)


def train(labelled: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """Learn from ``labelled`` (doc_id, text, lang): of each of the most frequent ``languages`` as many rows, those of
    least hash, ``sample`` in all (but LEAST of a language). Texts become subword shares on the executors."""
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not found:
        return None
    most = max(LEAST, sample // len(found))
    # hashes fall evenly: below this bound a language has about twice the rows wanted, or all that it has
    bound = [(r["lang"], min(int(2 * most / r["n"] * 2**64), 2**64 - 1) - 2**63) for r in found]
    bounds = F.broadcast(labelled.sparkSession.createDataFrame(bound, "lang string, bound long"))  # ``languages`` rows at most
    near = labelled.join(bounds, "lang").where("h <= bound")
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    chosen = near.select("lang", "h", F.xxhash64("text").alias("t"), F.row_number().over(first).alias("i")).where(F.col("i") <= most).select("lang", "h", "t").distinct()
    rows = near.join(F.broadcast(chosen), (near["lang"] == chosen["lang"]) & (near["h"] == chosen["h"]) & (F.xxhash64("text") == chosen["t"]), "left_semi")
    rows = rows.select("text", near["lang"]).distinct()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = counted(part.column("text"))
                hit = [np.flatnonzero(r) for r in found]
                at = pa.array([h.astype("<i2").tobytes() for h in hit], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("lang"), at, pa.array([r[h].tobytes() for r, h in zip(found, hit, strict=True)], pa.binary())], ["lang", "at", "share"])

    got = rows.mapInArrow(shares, "lang string, at binary, share binary").collect()  # max(sample, LEAST * languages) rows at most
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return None
    got.sort(key=lambda r: tuple(r))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<i2")] = np.frombuffer(r["share"], np.float32)
    return fit(x, np.array([langs.index(r["lang"]) for r in got]), langs)


def judged(text: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's language, score and whether it is rejected."""
    n = len(text)
    letters = np.zeros(n, bool)
    if model is not None:
        for i in range(0, n, 64):  # a few Python strings at a time
            letters[i : i + 64] = [t is not None and (t[:1].isalpha() or any(map(str.isalpha, t))) for t in text.slice(i, 64).to_pylist()]
    p = model.scores(text) if model else np.zeros((n, 1))
    names = np.array(model.langs if model else ["und"], dtype=object)[p.argmax(1)]
    names[~letters] = "und"
    score = np.where(letters, p.max(1), 0.0)
    return names, score, ~letters | (score < (model.reject if model else 1))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``."""
    docs = docs.drop("lang_pred", "score", "rejected")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = judged(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns; rows are dropped where they are read."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~judged(batch.column("text"), model)[2]))

    return docs.mapInArrow(kept, docs.schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of doc_id as text, mod 4, is not 2."""
    return docs.where(~held_out())


def held_out():
    """Crc32 of doc_id as text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
