"""Column expressions: stable log-space arithmetic, losses and feature arithmetic. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
LN2 = math.log(2.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.log(p) - F.log1p(-p)


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def log_sigmoid_complement(x: Column) -> Column:
    """log(1 - sigmoid(x))."""
    return log_sigmoid(-x)


def clipped_log(p: Column, eps: float = EPS) -> Column:
    return F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(eps)))


def log1mexp(x: Column, eps: float = EPS) -> Column:
    """log(1 - exp(-|x|)); x within ``eps`` of 0 counts as -eps, so the result is finite."""
    x = F.least(-F.abs(x), F.lit(-eps))
    return F.when(x > -LN2, F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def logsumexp(values: Column) -> Column:
    """Of an array of doubles; null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))


def bce_log(click: Column, log_prob: Column) -> Column:
    """Binary cross-entropy from the log-probability of a click."""
    return -F.when(click == 1, log_prob).otherwise(log1mexp(log_prob))


def bce_prob(click: Column, prob: Column) -> Column:
    return -F.when(click == 1, clipped_log(prob)).otherwise(clipped_log(1 - prob))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, where ``use`` names it inside a lambda over an array."""
    return F.transform(F.array(value), use)[0]


def layer_norm(values: Column, eps: float = 1e-6) -> Column:
    """An array of numbers shifted and scaled to mean 0 and (biased) variance 1."""
    values = F.transform(values, lambda v: v.cast("double"))
    centred = bound(F.struct(values.alias("v"), (total(values) / F.size(values)).alias("m")), lambda x: F.transform(x["v"], lambda v: v - x["m"]))

    def scale(x: Column) -> Column:
        spread = F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps)
        return bound(F.struct(x.alias("v"), spread.alias("s")), lambda y: F.transform(y["v"], lambda v: v / y["s"]))

    return bound(centred, scale)


def linear_score(values: Column, weights: Column, bias: Column | float = 0.0) -> Column:
    return total(F.zip_with(values, weights, lambda v, w: v.cast("double") * w)) + bias


def perplexity(mean_log_prob: Column) -> Column:
    """From a mean of natural log-probabilities of what was observed."""
    return F.pow(F.lit(2.0), -mean_log_prob / LN2)
