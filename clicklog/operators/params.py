"""Parameter tables: a logit for each key, and a baseline for keys that were never seen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicklog.functions import exprs, keys

#: Tables of so many keys at most are broadcast; larger ones are joined by a shuffle on the key.
BROADCAST_MOST = 100_000


@dataclass
class Param:
    """``logit()`` of impressions that went through ``lookup``: a literal, a table's column, or a baseline."""

    name: str
    keys: tuple[str, ...] = ()
    table: DataFrame | None = None
    baseline: float = 0.0
    column: str = "logit"
    rows: int | None = None
    fixed: Column | None = None
    computed: dict[str, Column] | None = None
    sign: Column | None = None

    @property
    def logit_name(self) -> str:
        return f"_{self.name}"

    def lookup(self, impressions: DataFrame) -> DataFrame:
        if self.fixed is not None:
            return impressions.withColumn(self.logit_name, self.fixed)
        if self.table is None:
            return impressions.withColumn(self.logit_name, F.lit(float(self.baseline)))
        own = impressions.columns
        at = {k: f"{self.logit_name}_{k}" if k in (self.computed or {}) else k for k in self.keys}
        impressions = impressions.withColumns({at[k]: c for k, c in (self.computed or {}).items()})
        small = self.table.select(*(F.col(k).alias(at[k]) for k in self.keys), F.col(self.column).alias(self.logit_name))
        if self.rows is not None and self.rows <= BROADCAST_MOST:
            small = F.broadcast(small)
        joined = impressions.join(small, list(at.values()), "left")
        value = F.col(self.logit_name) if self.sign is None else keys.signed(F.col(self.logit_name), self.sign)
        return joined.withColumn(self.logit_name, F.coalesce(value, F.lit(float(self.baseline)))).select(*own, self.logit_name)

    def logit(self) -> Column:
        return F.col(self.logit_name)

    def log_prob(self) -> Column:
        return exprs.log_sigmoid(self.logit())

    def log_complement(self) -> Column:
        return exprs.log_sigmoid_complement(self.logit())

    def prob(self) -> Column:
        return exprs.sigmoid(self.logit())


def constant(name: str, prob: float) -> Param:
    import math

    return Param(name, baseline=math.log(prob / (1 - prob)))


def from_rates(name: str, rates: DataFrame, keys: tuple[str, ...], rate: str, unseen: float, rows: int | None = None) -> Param:
    """A table of probabilities as a parameter; ``unseen`` is the probability of keys that it lacks."""
    import math

    table = rates.select(*keys, exprs.logit(F.col(rate)).alias("logit"))
    return Param(name, keys, table, math.log(unseen / (1 - unseen)), rows=rows)


def hashed(name: str, key: Column, size: int, table: DataFrame, baseline: float = 0.0, ratio: int = 10) -> Param:
    """A parameter under the hash trick: ``table`` has a logit for each ``bucket``, a key's sign turns it."""
    bucket, sign = keys.hash_trick(key, size, ratio)
    return Param(name, ("bucket",), table, baseline, computed={"bucket": bucket}, sign=sign)
