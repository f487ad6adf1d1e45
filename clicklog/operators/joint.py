"""Click models whose attraction is a network over features, fitted together with their parameters of ranks.

The click model's gradient by an impression's attraction logit goes into the network's back-propagation in one Arrow pass.
In the position-based model that gradient depends on one impression and is taken inside the pass; in chain models it comes
from window sums over sessions (:func:`clicklog.operators.fit.chain_gradient`). What is fitted beside the network is small: a logit for each rank, a second network over bias
features, or one logit for all. Tasks yield one vector each; vectors are added in a tree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklog.functions import exprs
from clicklog.operators import features as N
from clicklog.operators import fit, models
from clicklog.operators.params import Param

#: Least distance of a click probability from 0 and 1.
EPS = 1e-10


def product_loss(z: np.ndarray, e: np.ndarray, click: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the weighted loss of clicks with probability sigmoid(z) sigmoid(e), by z and by e, and the summed loss."""
    a, t = N.sigmoid(z), N.sigmoid(e)
    p = np.clip(a * t, EPS, 1 - EPS)
    odds = p / (1 - p)
    hit = click == 1
    by_z, by_e = (w * np.where(hit, x - 1, odds * (1 - x)) for x in (a, t))
    return by_z, by_e, float(-(w * np.where(hit, np.log(p), np.log1p(-p))).sum())


def _ranks(positions: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(positions.astype(np.int64) - 1, values, n)[:n]


@dataclass
class TwoTower:
    """A position-based model: a network of attraction, and a logit for each rank or a network over bias features."""

    attraction: N.Network
    ranks: np.ndarray | None = None
    bias: N.Network | None = None
    features: str = "features"
    bias_features: str = "bias_features"

    def scored(self, rows: DataFrame, only: tuple[str, ...] = ("cond_log_prob", "log_prob", "relevance")) -> DataFrame:
        own = rows.columns
        rows = N.score(rows, self.attraction, self.features, "_z")
        if self.bias is not None:
            rows, exam = N.score(rows, self.bias, self.bias_features, "_e"), Param("examination", fixed=F.col("_e"))
        else:
            exam = Param("examination", fixed=by_rank(self.ranks))
        return models.PositionBased(Param("attraction", fixed=F.col("_z")), exam).score(rows, only).select(*own, *only)


def by_rank(logits: np.ndarray) -> Column:
    """A rank's logit out of a few; 0 beyond them."""
    return F.coalesce(F.try_element_at(F.array(*(F.lit(float(x)) for x in logits)), F.col("position").cast("int")), F.lit(0.0))


def two_tower_gradient(rows: DataFrame, model: TwoTower) -> tuple[list[np.ndarray], np.ndarray, float, float]:
    """Summed gradients by the attraction network's parameters and by the ranks' logits, summed loss and weight.

    With a bias network the second are the gradients by its parameters, flattened."""
    ranks, bias, of_bias = model.ranks, model.bias, model.bias_features
    shapes = [p.shape for p in bias.parameters()] if bias is not None else []
    n = sum(int(np.prod(s)) for s in shapes) if bias is not None else len(ranks)

    def losses(batch: pa.RecordBatch, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        click, w = N.column(batch, "click"), N.column(batch, "w")
        if bias is None:
            at = N.column(batch, "position").astype(np.int64)
            known = at <= n
            by_z, by_e, loss = product_loss(z, np.where(known, ranks[np.minimum(at, n) - 1], 0.0), click, w)
            return by_z, np.append(_ranks(at[known], by_e[known], n), [loss, w.sum()])
        x = N._matrix(batch.column(of_bias))
        by_z, by_e, loss = product_loss(z, bias.logits(x), click, w)
        return by_z, np.concatenate([*(g.ravel() for g in bias.back(x, lambda _: by_e)), [loss, w.sum()]])

    columns = [c for c in ("session_id", "position", "click", "w", model.features, of_bias if bias is not None else None) if c]
    grads, rest = N.gradients(rows.select(*dict.fromkeys(columns)), model.attraction, losses, n + 2, model.features)
    return grads, rest[:n], float(rest[n]), float(rest[n + 1])


def fit_two_tower(rows: DataFrame, model: TwoTower, epochs: int = 5, rate: float = 0.01, decay: float = 0.0) -> tuple[TwoTower, list[float]]:
    """Fit both towers jointly to ``rows`` (session_id, position, click, w, features); the losses before each step."""
    second = [model.ranks] if model.bias is None else model.bias.parameters()
    first = model.attraction.parameters()
    steps, losses = N.Steps([*first, *second], rate, decay), []
    for _ in range(epochs):
        grads, rest, loss, seen = two_tower_gradient(rows, model)
        losses.append(loss / max(seen, 1e-12))
        cuts = np.cumsum([p.size for p in second])[:-1]
        more = [g.reshape(p.shape) for g, p in zip(np.split(rest, cuts), second, strict=True)]
        now = steps.take([g / max(seen, 1e-12) for g in (*grads, *more)])
        attraction, other = model.attraction.rebuilt(now[: len(first)]), now[len(first) :]
        model = replace(model, attraction=attraction, ranks=other[0]) if model.bias is None else replace(model, attraction=attraction, bias=model.bias.rebuilt(other))
    return model, losses


@dataclass
class FeatureChain:
    """``kind`` dbn, sdbn, dcm or ccm with a network of attraction; ``other`` holds the satisfaction logit (dbn, sdbn), the ranks'
    continuation logits (dcm) or nothing (ccm)."""

    kind: str
    attraction: N.Network
    other: np.ndarray
    going: float = 0.9
    features: str = "features"

    def with_logits(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_z``. A linear attraction is a column, which leaves a log bucketed by session as it is dealt; other
        networks pass through Arrow, after which Spark deals the rows by session once."""
        x = F.col(self.features)
        if isinstance(self.attraction, N.Linear):
            return rows.withColumn("_z", N.linear_logit(self.features, self.attraction.weights.tolist(), float(self.attraction.bias[0])))
        if getattr(self.attraction, "by_session", False):
            return N.score(rows, self.attraction, self.features, "_z")
        return rows.withColumn("_z", N.as_column(self.attraction)(x))

    def model(self) -> models.ChainModel:
        z = Param("attraction", fixed=F.col("_z"))
        if self.kind == "ccm":
            return models.ClickChain(z)
        if self.kind == "dcm":
            return models.DependentClick(z, Param("continuation", fixed=by_rank(self.other)))
        return models.DynamicBayesian(z, Param("satisfaction", fixed=F.lit(float(self.other[0]))), going=1.0 if self.kind == "sdbn" else self.going)

    def scored(self, rows: DataFrame, only: tuple[str, ...] = ("cond_log_prob", "log_prob", "relevance")) -> DataFrame:
        own = rows.columns
        return self.model().score(self.with_logits(rows), only).select(*own, *only)


def chain_rows(rows: DataFrame, chain: FeatureChain) -> DataFrame:
    """Impressions with ``g_z`` and ``g_k``: the gradient of the session-mean loss by the attraction logit, and by the other one."""
    model = chain.model()
    g = fit.chain_gradient(chain.with_logits(rows), model)
    a, by_z, by_k = model.attraction.prob(), F.col("g_attraction"), F.lit(0.0)
    if chain.kind == "ccm":
        by_z = by_z + F.col("g_click") * (model.tau3 - model.tau2) * a * (1 - a)
    elif chain.kind == "dcm":
        c = model.continuation.prob()
        by_k = F.col("g_click") * c * (1 - c)
    else:
        s = model.satisfaction.prob()
        by_k = -F.col("g_click") * model.going * s * (1 - s)
    return g.select("session_id", "position", "w", chain.features, by_z.alias("g_z"), by_k.alias("g_k"))


def chain_feature_gradient(rows: DataFrame, chain: FeatureChain) -> tuple[list[np.ndarray], np.ndarray]:
    """Summed gradients by the network's parameters and by the other logits."""
    n = len(chain.other)

    def losses(batch: pa.RecordBatch, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_k = N.column(batch, "g_k")
        at = N.column(batch, "position").astype(np.int64)
        return N.column(batch, "g_z"), by_k.sum(keepdims=True) if chain.kind in ("dbn", "sdbn") else _ranks(at[at <= n], by_k[at <= n], n)

    return N.gradients(chain_rows(rows, chain), chain.attraction, losses, n, chain.features)


def fit_feature_chain(rows: DataFrame, chain: FeatureChain, validation: DataFrame | None = None, epochs: int = 5, rate: float = 0.01) -> tuple[FeatureChain, list[float]]:
    """Fit the network and the other logits jointly; the session-mean losses before each step and after the last.

    ``rows`` should be bucketed by session; ``validation`` (or ``rows``) is what the losses are taken on."""
    sessions = rows.agg(F.sum("w").alias("s")).first()["s"] or 1.0
    first, held = chain.attraction.parameters(), rows if validation is None else validation

    def loss(chain: FeatureChain) -> float:
        scored = chain.scored(held, ("cond_log_prob",)).agg(F.sum(F.col("w") * exprs.bce_log(F.col("click"), F.col("cond_log_prob"))).alias("l"), F.sum("w").alias("w")).first()
        return scored["l"] / max(scored["w"] or 0.0, 1e-12) if scored["l"] is not None else 0.0

    steps, losses = N.Steps([*first, chain.other], rate), [loss(chain)]
    for _ in range(epochs):
        grads, other = chain_feature_gradient(rows, chain)
        now = steps.take([g / sessions for g in (*grads, other)])
        chain = replace(chain, attraction=chain.attraction.rebuilt(now[:-1]), other=now[-1])
        losses.append(loss(chain))
    return chain, losses
