"""Parameters that share storage: signed buckets, quotient and remainder tables, one array of overlapping blocks.

Each is a :class:`clicklog.operators.params.Param` for any slot of a click model: ``lookup`` adds an impression's logit,
``gradients`` turns gradients by keys' logits into gradients of what is stored, ``stepped`` takes an Adam step on it.
Stored vectors are arrays of ``features`` numbers; a logit is their sum, weighed by ``weights``, plus the baseline.
Large tables are joined on their codes, tables of a size that a setting bounds are broadcast. Fits run on cells (sums of clicks
and views by key), so that an iteration reads one row for each key, or key and rank, not the log.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklog.functions import exprs, keys
from clicklog.operators.fit import checkpointed
from clicklog.operators.joint import by_rank
from clicklog.operators.features import Steps
from clicklog.operators.params import BROADCAST_MOST, Param

BETA1, BETA2, TINY = 0.9, 0.999, 1e-8


def adam(table: DataFrame, key: str, gradient: DataFrame, step: int, rate: float) -> DataFrame:
    """A step of Adam on (key, values, m, v) arrays by (key, g) arrays; keys without a gradient stay as they are."""
    both = table.join(gradient, key, "left")
    mixed = lambda old, new, beta: F.zip_with(old, new, lambda a, b: a * beta + b * (1 - beta))
    both = both.withColumn("_m", mixed("m", "g", BETA1)).withColumn("_v", mixed("v", F.transform("g", lambda x: x * x), BETA2))
    move = F.zip_with("_m", "_v", lambda m, v: rate * (m / (1 - BETA1**step)) / (F.sqrt(v / (1 - BETA2**step)) + TINY))
    both = both.withColumn("_x", F.zip_with("values", move, lambda x, d: x - d))
    new = lambda a, b: F.when(F.col("g").isNull(), F.col(b)).otherwise(F.col(a)).alias(b)
    return checkpointed(both.select(key, new("_x", "values"), new("_m", "m"), new("_v", "v")))


def stored(codes: DataFrame, key: str, values: Column) -> DataFrame:
    """A table of distinct codes with first values and an empty Adam state."""
    none = F.transform(values, lambda x: x * 0.0)
    return codes.select(key).distinct().select(key, values.alias("values"), none.alias("m"), none.alias("v"))


def summed(grads: list[Column]) -> Column:
    return F.array(*(F.sum(g) for g in grads)).alias("g")


@dataclass
class Shared(Param):
    """``key`` is the column that is coded; ``size`` the number of its values, ``ratio`` how many of them share a code."""

    key: str = "query_doc_id"
    size: int = 1
    ratio: int = 10
    features: int = 1
    weights: tuple[float, ...] = ()

    def weight(self, i: int) -> float:
        return self.weights[i] if self.weights else 1.0

    def lookup(self, impressions: DataFrame) -> DataFrame:
        return self.logits(impressions)

    def logits(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the logit of their key."""
        raise NotImplementedError

    def gradients(self, by_key: DataFrame) -> dict[str, DataFrame]:
        """Gradients of the stored tables from ``key, g``, the gradient by a key's logit."""
        raise NotImplementedError

    def stepped(self, by_key: DataFrame, step: int, rate: float) -> Shared:
        """The parameter after a step of Adam on its tables."""
        raise NotImplementedError


@dataclass
class Signed(Shared):
    """The hash trick: keys of a bucket share a value and differ in sign. ``values`` (bucket, values, m, v)."""

    buckets: DataFrame = None

    def codes(self) -> tuple[Column, Column]:
        return keys.hash_trick(F.col(self.key), self.size, self.ratio)

    def coded(self, rows: DataFrame) -> DataFrame:
        bucket, sign = self.codes()
        return rows.withColumns({"_bucket": bucket, "_sign": sign})

    def logits(self, rows: DataFrame) -> DataFrame:
        table = self.buckets.select(F.col("bucket").alias("_bucket"), F.col("values")[0].alias("_value"))
        value = F.col("_sign") * F.coalesce("_value", F.lit(0.0)) + self.baseline
        return self.coded(rows).join(table, "_bucket", "left").withColumn(self.logit_name, value).select(*rows.columns, self.logit_name)

    def gradients(self, by_key: DataFrame) -> dict[str, DataFrame]:
        return {"buckets": self.coded(by_key).groupBy(F.col("_bucket").alias("bucket")).agg(summed([F.col("_sign") * F.col("g")]))}

    def stepped(self, by_key: DataFrame, step: int, rate: float) -> Signed:
        return replace(self, buckets=adam(self.buckets, "bucket", self.gradients(by_key)["buckets"], step, rate))


@dataclass
class QuotientRemainder(Shared):
    """A key's vector is made of its quotient's and its remainder's: ``how`` product, sum or concat (``projection``:
    ``features`` rows of 2 ``features`` numbers). Remainders are ``ratio`` rows."""

    quotients: DataFrame = None
    remainders: DataFrame = None
    how: str = "product"
    projection: list[list[float]] = field(default_factory=list)

    def coded(self, rows: DataFrame) -> DataFrame:
        """``rows`` with codes and both vectors (zeros for codes that were never stored)."""
        quotient, remainder = keys.quotient_remainder(F.col(self.key), self.size, self.ratio)
        rows = rows.withColumns({"quotient": quotient, "remainder": remainder})
        second = self.remainders.select("remainder", F.col("values").alias("_r"))
        rows = rows.join(F.broadcast(second) if self.ratio <= BROADCAST_MOST else second, "remainder", "left")
        rows = rows.join(self.quotients.select("quotient", F.col("values").alias("_q")), "quotient", "left")
        zeros = F.array(*[F.lit(0.0)] * self.features)
        return rows.withColumns({"_q": F.coalesce("_q", zeros), "_r": F.coalesce("_r", zeros)})

    def _from(self, i: int) -> float:
        """How much the i-th number of quotient and remainder, side by side, counts in a projected logit."""
        return sum(self.weight(k) * row[i] for k, row in enumerate(self.projection))

    def logits(self, rows: DataFrame) -> DataFrame:
        n, q, r = self.features, F.col("_q"), F.col("_r")
        if self.how == "product":
            parts = [q[i] * r[i] * self.weight(i) for i in range(n)]
        elif self.how == "sum":
            parts = [(q[i] + r[i]) * self.weight(i) for i in range(n)]
        else:
            parts = [q[i] * self._from(i) + r[i] * self._from(n + i) for i in range(n)]
        return self.coded(rows).withColumn(self.logit_name, sum(parts, F.lit(float(self.baseline)))).select(*rows.columns, self.logit_name)

    def gradients(self, by_key: DataFrame) -> dict[str, DataFrame]:
        n, g, q, r = self.features, F.col("g"), F.col("_q"), F.col("_r")
        of = {"product": lambda i: (r[i] * self.weight(i), q[i] * self.weight(i)), "sum": lambda i: (F.lit(self.weight(i)), F.lit(self.weight(i)))}
        slopes = [of.get(self.how, lambda i: (F.lit(self._from(i)), F.lit(self._from(n + i))))(i) for i in range(n)]
        rows = self.coded(by_key)
        return {name: rows.groupBy(code).agg(summed([g * s[k] for s in slopes])) for k, (name, code) in enumerate((("quotients", "quotient"), ("remainders", "remainder")))}

    def stepped(self, by_key: DataFrame, step: int, rate: float) -> QuotientRemainder:
        g = self.gradients(by_key)
        return replace(self, quotients=adam(self.quotients, "quotient", g["quotients"], step, rate), remainders=adam(self.remainders, "remainder", g["remainders"], step, rate))


@dataclass
class SharedArray(Shared):
    """One array of numbers: a key's vector are ``features`` signed neighbours from a hashed start, round the end. The array is
    kept in blocks of ``block`` numbers (block, values, m, v), so that a key meets one or two rows and the array may be
    larger than any broadcast."""

    blocks: DataFrame = None
    block: int = 64

    @property
    def slots(self) -> int:
        return max(1, self.size * self.features // self.ratio)

    def parts(self, rows: DataFrame) -> DataFrame:
        """``rows`` once for each block that their key meets: ``block`` and ``_part``, the (place, coefficient) pairs inside."""
        at, signs = keys.robe(F.col(self.key), self.size, self.features, self.ratio)
        weights = F.array(*(F.lit(float(self.weight(i))) for i in range(self.features)))
        item = F.zip_with(at, F.zip_with(signs, weights, lambda s, w: s * w), lambda a, c: F.struct(F.floor(a / self.block).cast("long").alias("block"), (a % self.block).cast("int").alias("place"), c.alias("c")))
        rows = rows.withColumn("_items", item)
        rows = rows.withColumn("block", F.explode(F.array_distinct(F.col("_items.block"))))
        return rows.withColumn("_part", F.filter("_items", lambda x: x["block"] == F.col("block"))).drop("_items")

    def logits(self, rows: DataFrame) -> DataFrame:
        each = self.parts(rows.select(self.key).distinct()).join(self.blocks.select("block", "values"), "block", "left")
        part = F.aggregate("_part", F.lit(0.0), lambda s, x: s + x["c"] * F.coalesce(F.col("values")[x["place"]], F.lit(0.0)))
        found = each.groupBy(self.key).agg((F.sum(part) + self.baseline).alias(self.logit_name))
        return rows.join(found, self.key).select(*rows.columns, self.logit_name)

    def gradients(self, by_key: DataFrame) -> dict[str, DataFrame]:
        each = self.parts(by_key).select("block", "g", F.explode("_part").alias("x"))
        each = each.groupBy("block", F.col("x.place").alias("place")).agg(F.sum(F.col("g") * F.col("x.c")).alias("g"))
        whole = each.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", "g"))).alias("by_place"))  # ``block`` numbers
        filled = F.transform(F.sequence(F.lit(0), F.lit(self.block - 1)), lambda i: F.coalesce(F.try_element_at("by_place", i), F.lit(0.0)))
        return {"blocks": whole.select("block", filled.alias("g"))}

    def stepped(self, by_key: DataFrame, step: int, rate: float) -> SharedArray:
        return replace(self, blocks=adam(self.blocks, "block", self.gradients(by_key)["blocks"], step, rate))


def cell_gradients(cells: DataFrame, param: Shared, ranks: np.ndarray | None = None) -> DataFrame:
    """``cells`` (key, [position,] clicks, views) with ``g_z`` and ``g_e``, the loss's gradients by the key's and the rank's logit,
    and ``loss``. Without ``ranks`` a click's probability is the key's."""
    rows = param.logits(cells)
    a, t = param.prob(), F.lit(1.0) if ranks is None else exprs.sigmoid(by_rank(ranks))
    rows = rows.withColumn("_a", a).withColumn("_t", t).withColumn("_p", F.least(F.greatest(F.col("_a") * F.col("_t"), F.lit(exprs.EPS)), F.lit(1 - exprs.EPS)))
    none, odds = F.col("views") - F.col("clicks"), F.col("_p") / (1 - F.col("_p"))
    by = lambda x: (none * odds - F.col("clicks")) * (1 - F.col(x))
    loss = -(F.col("clicks") * F.log("_p") + none * F.log1p(-F.col("_p")))
    return rows.select(*cells.columns, by("_a").alias("g_z"), by("_t").alias("g_e"), loss.alias("loss"))


def fit_compressed(cells: DataFrame, param: Shared, ranks: np.ndarray | None = None, iterations: int = 20, rate: float = 0.1, tolerance: float = 0.0) -> tuple[Shared, np.ndarray | None, list[float]]:
    """Fit a compressed parameter, and the ranks' logits if there are any, on cells by Adam until the loss falls by less than
    ``tolerance``; the losses before each step."""
    cells = checkpointed(cells)
    total = cells.agg(F.sum("views").alias("v")).first()["v"] or 1.0
    steps, losses = Steps([ranks], rate) if ranks is not None else None, []
    for step in range(1, iterations + 1):
        rows = cell_gradients(cells, param, ranks)
        rows = checkpointed(rows.groupBy(param.key, *(["position"] if ranks is not None else [])).agg(*(F.sum(c).alias(c) for c in ("g_z", "g_e", "loss"))))
        losses.append(rows.agg(F.sum("loss").alias("l")).first()["l"] / total)
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance:
            break
        if steps is not None:
            by = {r["position"]: r["g"] for r in rows.groupBy("position").agg(F.sum("g_e").alias("g")).where(F.col("position") <= len(ranks)).collect()}  # a row for each rank
            ranks = steps.take([np.array([by.get(k + 1, 0.0) / total for k in range(len(ranks))])])[0]
        param = param.stepped(rows.groupBy(param.key).agg((F.sum("g_z") / total).alias("g")), step, rate)
    return param, ranks, losses
