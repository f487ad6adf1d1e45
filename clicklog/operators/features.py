"""Feature-based parameters: any of them yields a logit column that a model's parameter slot can take."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicklog.functions import exprs
from clicklog.functions.keys import COEFFICIENTS, PRIME


def fixed_weights(n: int, salt: int = 0) -> list[float]:
    """Reproducible weights in [-1, 1)."""
    return [((COEFFICIENTS[0] + COEFFICIENTS[1] * (i + 1) + COEFFICIENTS[2] * salt) % PRIME) / PRIME * 2 - 1 for i in range(n)]


def linear_logit(features: str, weights: list[float], bias: float):
    """w . layer_norm(features) + b as a column."""
    return exprs.linear_score(exprs.layer_norm(F.col(features)), F.array(*map(F.lit, weights)), F.lit(bias))


def _norm(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + eps)


def _elu(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, np.expm1(np.minimum(x, 0)))


def _elu_slope(out: np.ndarray) -> np.ndarray:
    """The slope of ELU by its value."""
    return np.where(out > 0, 1, out + 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: Gives the gradient by each row's logit from the logits.
ByLogit = Callable[[np.ndarray], np.ndarray]


class Deep:
    """A feed-forward network: layer norm, hidden layers with ELU, one logit. ``layers`` holds (weights, bias) pairs."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.layers = layers

    @classmethod
    def seeded(cls, width: int, hidden: tuple[int, ...] = (16, 16), seed: int = 0) -> Deep:
        rng, sizes = np.random.default_rng(seed), [width, *hidden, 1]
        return cls([(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [_norm(x)]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(_elu(z) if i < len(self.layers) - 1 else z)
        return out

    def logits(self, x: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        return self.forward(x)[-1][:, 0]

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in layer]

    def rebuilt(self, params: list[np.ndarray]) -> Deep:
        return Deep(list(zip(params[::2], params[1::2], strict=True)))

    def back(self, x: np.ndarray, by_logit: ByLogit, bounds: np.ndarray | None = None) -> list[np.ndarray]:
        """Summed gradient in the order of the parameters, ``by_logit`` giving that by each row's logit."""
        out = self.forward(x)
        back, grads = by_logit(out[-1][:, 0])[:, None], []
        for i in range(len(self.layers) - 1, -1, -1):
            grads += [back.sum(0), out[i].T @ back]
            if i:
                back = back @ self.layers[i][0].T * _elu_slope(out[i])
        return grads[::-1]


class DeepCross:
    """Cross layers x0 * (W x + b) + x and deep layers, stacked or side by side, then one logit."""

    def __init__(self, width: int, cross: int = 2, hidden: tuple[int, ...] = (32, 32), stacked: bool = True, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.stacked = stacked
        self.cross = [(rng.normal(0, width**-0.5, (width, width)), np.zeros(width)) for _ in range(cross)]
        sizes = [width, *hidden]
        self.deep = [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.top = rng.normal(0, 0.1, sizes[-1] if stacked else sizes[-1] + width)

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Values of the cross and of the deep layers, and what the last weights meet."""
        crossed = [_norm(x)]
        for w, b in self.cross:
            crossed.append(crossed[0] * (crossed[-1] @ w + b) + crossed[-1])
        deep = [crossed[-1] if self.stacked else crossed[0]]
        for w, b in self.deep:
            deep.append(_elu(deep[-1] @ w + b))
        return crossed, deep, deep[-1] if self.stacked else np.concatenate([crossed[-1], deep[-1]], axis=1)

    def logits(self, x: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        return self.forward(x)[-1] @ self.top

    def parameters(self) -> list[np.ndarray]:
        return [*(p for layer in (*self.cross, *self.deep) for p in layer), self.top]

    def rebuilt(self, params: list[np.ndarray]) -> DeepCross:
        out, layers = copy.copy(self), list(zip(params[:-1:2], params[1::2], strict=True))
        out.cross, out.deep, out.top = layers[: len(self.cross)], layers[len(self.cross) :], params[-1]
        return out

    def back(self, x: np.ndarray, by_logit: ByLogit, bounds: np.ndarray | None = None) -> list[np.ndarray]:
        """As :meth:`Deep.back`."""
        crossed, deep, last = self.forward(x)
        by = by_logit(last @ self.top)
        back, grads = by[:, None] * self.top, [last.T @ by]
        back_cross, back = (None, back) if self.stacked else (back[:, : x.shape[1]], back[:, x.shape[1] :])
        for i in range(len(self.deep) - 1, -1, -1):
            back = back * _elu_slope(deep[i + 1])
            grads += [back.sum(0), deep[i].T @ back]
            back = back @ self.deep[i][0].T
        back = back if self.stacked else back_cross
        for i in range(len(self.cross) - 1, -1, -1):
            inner = back * crossed[0]
            grads += [inner.sum(0), crossed[i].T @ inner]
            back = back + inner @ self.cross[i][0].T
        return grads[::-1]


class Linear:
    """w . layer_norm(x) + b."""

    def __init__(self, weights: np.ndarray, bias: float = 0.0):
        self.weights, self.bias = np.asarray(weights, float), np.array([bias], float)

    def logits(self, x: np.ndarray, bounds: np.ndarray | None = None) -> np.ndarray:
        return _norm(x) @ self.weights + self.bias[0]

    def parameters(self) -> list[np.ndarray]:
        return [self.weights, self.bias]

    def rebuilt(self, params: list[np.ndarray]) -> Linear:
        return Linear(params[0], float(params[1][0]))

    def back(self, x: np.ndarray, by_logit: ByLogit, bounds: np.ndarray | None = None) -> list[np.ndarray]:
        """As :meth:`Deep.back`."""
        x = _norm(x)
        by = by_logit(x @ self.weights + self.bias[0])
        return [by @ x, by.sum(keepdims=True)]


class Attention:
    """Single-head attention over the documents of a session, then one logit for each: a session's scores depend on all
    that it shows. ``qkv`` are (weights, bias) of queries, keys and values, ``out`` leads back to the features, ``top`` to the
    logit. Rows come by session: ``bounds`` are the first rows of sessions, and one more at the end."""

    by_session = True

    def __init__(self, qkv: list[tuple[np.ndarray, np.ndarray]], out: tuple[np.ndarray, np.ndarray], top: tuple[np.ndarray, np.ndarray]):
        self.qkv, self.out, self.top = qkv, out, top

    @classmethod
    def seeded(cls, width: int, inner: int = 8, seed: int = 0) -> Attention:
        rng = np.random.default_rng(seed)
        layer = lambda a, b: (rng.normal(0, a**-0.5, (a, b)), np.zeros(b))
        return cls([layer(width, inner) for _ in range(3)], layer(inner, width), layer(width, 1))

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of the rows in a (session, rank) grid, and the grid's values: queries, keys, values, attention, its result."""
        sizes = np.diff(bounds)
        session = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.arange(len(x)) - np.repeat(bounds[:-1], sizes)
        there = np.arange(max(sizes.max(initial=0), 1)) < sizes[:, None]
        grid = []
        for w, b in self.qkv:
            full = np.zeros((*there.shape, w.shape[1]))
            full[session, rank] = x @ w + b
            grid.append(full)
        q, k, v = grid
        scores = np.where(there[:, None, :], q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[2]), -np.inf)
        scores = np.exp(scores - scores.max(2, keepdims=True))
        share = scores / scores.sum(2, keepdims=True)
        return session, rank, q, k, v, share, share @ v

    def logits(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        session, rank, *_, mixed = self.forward(x, bounds)
        return ((mixed[session, rank] @ self.out[0] + self.out[1]) @ self.top[0] + self.top[1])[:, 0]

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in (*self.qkv, self.out, self.top) for p in layer]

    def rebuilt(self, params: list[np.ndarray]) -> Attention:
        layers = list(zip(params[::2], params[1::2], strict=True))
        return Attention(layers[:3], layers[3], layers[4])

    def back(self, x: np.ndarray, by_logit: ByLogit, bounds: np.ndarray) -> list[np.ndarray]:
        """As :meth:`Deep.back`."""
        session, rank, q, k, v, share, mixed = self.forward(x, bounds)
        own = mixed[session, rank]
        last = own @ self.out[0] + self.out[1]
        by = by_logit((last @ self.top[0] + self.top[1])[:, 0])[:, None]
        by_last = by @ self.top[0].T
        by_mixed = np.zeros_like(mixed)
        by_mixed[session, rank] = by_last @ self.out[0].T
        by_share = by_mixed @ v.transpose(0, 2, 1)
        by_score = share * (by_share - (by_share * share).sum(2, keepdims=True)) / np.sqrt(q.shape[2])
        by_q, by_k, by_v = by_score @ k, by_score.transpose(0, 2, 1) @ q, share.transpose(0, 2, 1) @ by_mixed
        grads = []
        for g in (by_q, by_k, by_v):
            g = g[session, rank]
            grads += [x.T @ g, g.sum(0)]
        return [*grads, own.T @ by_last, by_last.sum(0), last.T @ by, by.sum(0)]


Network = Deep | DeepCross | Linear | Attention


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column (not empty) as rows, out of its Arrow buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _bounds(sessions: pa.Array) -> np.ndarray:
    """The first rows of sessions, and one more at the end."""
    ids = sessions.to_numpy(zero_copy_only=False)
    return np.concatenate([np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), [len(ids)]])


def whole_sessions(batches: Iterator[pa.RecordBatch], session: str = "session_id") -> Iterator[pa.RecordBatch]:
    """Batches of rows in session order, cut anew so that none parts a session: the last session of each waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(session).to_numpy(zero_copy_only=False)
        if waiting and waiting[0].column(session)[0].as_py() == ids[0] == ids[-1]:
            waiting.append(batch)
            continue
        last = int(_bounds(batch.column(session))[-2])
        ended = pa.Table.from_batches([*waiting, batch.slice(0, last)], batch.schema).combine_chunks().to_batches()
        yield from ended
        waiting = [batch.slice(last)]
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def by_session(rows: DataFrame) -> DataFrame:
    """``rows`` dealt and sorted by session; for a log that is bucketed and sorted so, this moves and sorts nothing."""
    return rows.repartition("session_id").sortWithinPartitions("session_id", "position")


def score(rows: DataFrame, network: Network, features: str = "features", name: str = "logit") -> DataFrame:
    """Add the network's logit; weights are broadcast (their size is fixed by the network).

    A network over whole sessions needs ``session_id`` and rows as :func:`by_session` gives them, or as a table that is
    bucketed and sorted by session does; sessions are then scored many at a time, cut at their borders in the stream of rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(network)
    together = getattr(network, "by_session", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_sessions(batches) if together else batches:
            bounds = _bounds(batch.column("session_id")) if together else None
            z = shared.value.logits(_matrix(batch.column(features)), bounds) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add(name, "double"))


def as_column(network: Network) -> Callable[[Column], Column]:
    """The network as a function of a column of features, on Arrow batches."""

    @F.arrow_udf("double")
    def logit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            yield pa.array(network.logits(_matrix(x)) if len(x) else np.zeros(0))

    return logit


#: Vectors that are added in one group.
FAN = 64


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of vectors of equal length, one for each task (task long, g binary): FAN at a time on the executors, twice;
    the driver adds one for FAN * FAN tasks."""

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x) for x in table.column("g").to_pylist())
        return pa.table({"task": table.column("task")[:1], "g": pa.array([whole.tobytes()], pa.binary())})

    for _ in range(2):
        parts = parts.select(F.expr(f"task div {FAN}").alias("task"), "g").groupBy("task").applyInArrow(add, "task long, g binary")
    left = [np.frombuffer(r["g"]) for r in parts.collect()]
    return sum(left[1:], left[0]) if left else np.zeros(0)


def gradients(rows: DataFrame, network: Network, losses: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]], more: int = 0, features: str = "features") -> tuple[list[np.ndarray], np.ndarray]:
    """Summed gradient by the network's parameters, and ``more`` summed numbers.

    ``losses`` gives, from a batch and its logits, the gradient by each logit and the batch's further numbers; back-propagation
    follows in the same pass. Each task yields one vector."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    shapes, together = [p.shape for p in network.parameters()], getattr(network, "by_session", False)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = [np.zeros(s) for s in shapes], np.zeros(more)
        for batch in whole_sessions(batches) if together else batches:
            if not batch.num_rows:
                continue

            def by_logit(z: np.ndarray, batch=batch) -> np.ndarray:
                g, extra = losses(batch, z)
                other[:] += extra
                return g

            bounds = _bounds(batch.column("session_id")) if together else None
            total = [a + b for a, b in zip(total, shared.value.back(_matrix(batch.column(features)), by_logit, bounds), strict=True)]
        flat = np.concatenate([*(t.ravel() for t in total), other])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["task", "g"])

    flat = summed(rows.mapInArrow(partial, "task long, g binary"))
    shared.destroy()
    if not len(flat):
        flat = np.zeros(sum(int(np.prod(s)) for s in shapes) + more)
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(flat, cuts)[:-1], shapes, strict=True)], flat[cuts[-1] :]


class Steps:
    """AdamW on a few arrays that the driver holds."""

    def __init__(self, params: list[np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.step = [p.astype(float).copy() for p in params], rate, decay, 0
        self.m, self.v = ([np.zeros(p.shape) for p in params] for _ in range(2))

    def take(self, grads: list[np.ndarray]) -> list[np.ndarray]:
        self.step += 1
        for i, g in enumerate(grads):
            self.m[i], self.v[i] = 0.9 * self.m[i] + 0.1 * g, 0.999 * self.v[i] + 0.001 * g * g
            move = (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)
            self.params[i] = self.params[i] - self.rate * (move + self.decay * self.params[i])
        return self.params


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def cross_entropy(batch: pa.RecordBatch, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted cross-entropy of clicks: by logit, and (loss, weight)."""
    click, w = column(batch, "click"), column(batch, "w")
    return (sigmoid(z) - click) * w, np.array([(w * (np.logaddexp(0, z) - click * z)).sum(), w.sum()])


def fit_deep(rows: DataFrame, network: Network, epochs: int = 5, rate: float = 0.01, decay: float = 1e-4, features: str = "features") -> tuple[Network, list[float]]:
    """Data-parallel training of click-through rates: tasks sum their gradients, the executors add the sums, the driver steps."""
    steps, losses, data = Steps(network.parameters(), rate, decay), [], rows.select(features, "click", "w")
    for _ in range(epochs):
        grads, (loss, seen) = gradients(data, network, cross_entropy, 2, features)
        seen = max(seen, 1e-12)
        losses.append(float(loss / seen))
        network = network.rebuilt(steps.take([g / seen for g in grads]))
    return network, losses


def fit_linear(rows: DataFrame, features: str = "features", penalty: float = 1e-3):
    """Logistic regression of clicks on layer-normed features, an impression weighing w."""
    ready = rows.select(array_to_vector(exprs.layer_norm(F.col(features))).alias("x"), F.col("click").cast("double").alias("click"), "w")
    return LogisticRegression(featuresCol="x", labelCol="click", weightCol="w", regParam=penalty, maxIter=30, standardization=False).fit(ready)
