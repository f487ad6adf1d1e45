"""Click and ranking metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicklog.functions import exprs


def observed(click: Column, log_prob: Column) -> Column:
    """Log-probability of what happened: a click, or none."""
    return -exprs.bce_log(click, log_prob)


def rank_average(rows: DataFrame, value: Column) -> DataFrame:
    """Sum, count and mean of ``value`` for each position, and over all (position null); absent ranks have no row."""
    out = rows.rollup("position").agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def average(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return rows.agg(F.avg(value).alias(name))


def session_mean(rows: DataFrame, value: Column, name: str = "loss") -> DataFrame:
    """Mean over sessions of their mean."""
    return rows.groupBy("session_id").agg(F.avg(value).alias("_v")).agg(F.avg("_v").alias(name))


def log_likelihood(rows: DataFrame, log_prob: str = "cond_log_prob") -> DataFrame:
    return rows.agg(F.avg(observed(F.col("click"), F.col(log_prob))).alias("ll"))


def log_likelihood_per_rank(rows: DataFrame, log_prob: str = "cond_log_prob") -> DataFrame:
    return rows.groupBy("position").agg(F.avg(observed(F.col("click"), F.col(log_prob))).alias("ll"))


def perplexity_per_rank(rows: DataFrame, log_prob: str = "log_prob", name: str = "ppl") -> DataFrame:
    return rows.groupBy("position").agg(exprs.perplexity(F.avg(observed(F.col("click"), F.col(log_prob)))).alias(name))


def perplexity(rows: DataFrame, log_prob: str = "log_prob", name: str = "ppl") -> DataFrame:
    """The mean over ranks of their perplexity."""
    return perplexity_per_rank(rows, log_prob, name).agg(F.avg(name).alias(name))


@dataclass(frozen=True)
class Binned:
    """A metric whose state has a row for each bin, whatever the number of impressions: ``by`` is a row's bin, ``sums`` what the
    rows of a bin add to it, ``finish`` the value from the array of (bin, sums...) structs in bin order.

    States are merged by adding the sums of equal bins, so that parts of a log, or partial aggregates, can be looked at
    apart and joined later."""

    by: Column
    sums: dict[str, Column]
    finish: Callable[[Column], Column]


def state(rows: DataFrame, metric: Binned) -> DataFrame:
    """``bin`` and the sums of its rows."""
    return rows.groupBy(metric.by.alias("bin")).agg(*(F.sum(c).alias(n) for n, c in metric.sums.items()))


def merged(states: list[DataFrame]) -> DataFrame:
    """One state from those of several parts."""
    whole = reduce(DataFrame.unionByName, states)
    return whole.groupBy("bin").agg(*(F.sum(n).alias(n) for n in whole.columns if n != "bin"))


def _array(bin: str, sums: dict[str, str]) -> Column:
    """Bins in order, without those of no row."""
    return F.sort_array(F.collect_list(F.struct(F.col(bin).alias("bin"), *(F.col(c).alias(n) for n, c in sums.items()))))


def finished(states: DataFrame, metric: Binned, name: str) -> DataFrame:
    """The metric's value in one row; a state has a row for each bin."""
    return states.agg(_array("bin", {n: n for n in metric.sums}).alias("_state")).select(metric.finish(F.col("_state")).alias(name))


def histogram(prob: Column, bins: int) -> Column:
    """The bin of a probability, of ``bins`` equal ones from 0."""
    return F.least(F.floor(prob * bins), F.lit(bins - 1)).cast("int")


def auc(prob: Column, bins: int = 1000) -> Binned:
    """The chance that a click has a higher predicted probability than a skip; equal bins count half."""
    start = F.struct(*(F.lit(0.0).alias(n) for n in ("area", "hits", "misses")))

    def step(at: Column, x: Column) -> Column:
        area = at["area"] + x["hit"] * (at["misses"] + x["miss"] / 2)
        return F.struct(area.alias("area"), (at["hits"] + x["hit"]).alias("hits"), (at["misses"] + x["miss"]).alias("misses"))

    end = lambda at: F.when(at["hits"] * at["misses"] > 0, at["area"] / (at["hits"] * at["misses"]))
    click = F.col("click").cast("double")
    return Binned(histogram(prob, bins), {"hit": click, "miss": 1 - click}, lambda bins_: F.aggregate(bins_, start, step, end))


def calibration_error(prob: Column, bins: int = 20) -> Binned:
    """The mean distance of predicted from observed click rates over bins, by their rows."""

    def finish(bins_: Column) -> Column:
        return exprs.total(F.transform(bins_, lambda x: F.abs(x["p"] - x["hit"]))) / exprs.total(F.transform(bins_, lambda x: x["n"]))

    return Binned(histogram(prob, bins), {"n": F.lit(1.0), "p": prob, "hit": F.col("click").cast("double")}, finish)


def evaluate_clicks(rows: DataFrame, prefix: str = "test_", max_positions: int = 10, more: dict[str, Column] | None = None, states: dict[str, Binned] | None = None) -> DataFrame:
    """ll, ppl, cond_ppl and loss of scored impressions in one row, the means over impressions of ``more`` columns, and the
    values of ``states``.

    One pass over the rows: sums for each cell (a position, and a bin of each state metric) are folded to positions and to
    bins, and the session means ride along as the weighted sum of losses.
    """
    click, own, states = F.col("click"), more or {}, states or {}
    seen = rows.select(
        "position", "w", "session_id", observed(click, F.col("cond_log_prob")).alias("c"), observed(click, F.col("log_prob")).alias("u"), *(c.alias(f"_{n}") for n, c in own.items()),
        *(m.by.alias(f"_by_{n}") for n, m in states.items()), *(c.alias(f"_of_{n}_{k}") for n, m in states.items() for k, c in m.sums.items()),
    )
    sums = {"c": F.col("c"), "u": F.col("u"), "k": F.lit(1), "wl": -F.col("c") * F.col("w"), "sessions": F.col("w")}
    sums |= {f"_{n}": F.col(f"_{n}") for n in own} | {f"_of_{n}_{k}": F.col(f"_of_{n}_{k}") for n, m in states.items() for k in m.sums}
    cells = seen.groupBy("position", *(f"_by_{n}" for n in states)).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    if states:
        arrays = [F.collect_list(F.struct(F.col(f"_by_{n}").alias("bin"), *(F.col(f"_of_{n}_{k}").alias(k) for k in m.sums))).alias(f"_in_{n}") for n, m in states.items()]
        cells = cells.groupBy("position").agg(*(F.sum(n).alias(n) for n in sums if not n.startswith("_of_")), *arrays)  # a rank's cells
    out = cells.agg(
        (F.sum("c") / F.sum("k")).alias(f"{prefix}ll"), F.avg(exprs.perplexity(F.col("u") / F.col("k"))).alias(f"{prefix}ppl"),
        F.avg(exprs.perplexity(F.col("c") / F.col("k"))).alias(f"{prefix}cond_ppl"), (F.sum("wl") / F.sum("sessions")).alias(f"{prefix}loss"),
        *((F.sum(f"_{n}") / F.sum("k")).alias(f"{prefix}{n}") for n in own), *(F.flatten(F.collect_list(f"_in_{n}")).alias(f"_in_{n}") for n in states),
    )
    return out.withColumns({f"{prefix}{n}": m.finish(_added(F.col(f"_in_{n}"), list(m.sums))) for n, m in states.items()}).drop(*(f"_in_{n}" for n in states)) if states else out


def _added(cells: Column, names: list[str]) -> Column:
    """Structs (bin, sums...) with those of equal bins added, in bin order."""
    bins = F.array_sort(F.array_distinct(F.transform(cells, lambda x: x["bin"])))
    of = lambda b, n: exprs.total(F.transform(F.filter(cells, lambda x: x["bin"] == b), lambda x: x[n]))
    return F.transform(bins, lambda b: F.struct(b.alias("bin"), *(of(b, n).alias(n) for n in names)))


def ranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """Add ``rank``: documents of a query by falling score, ties by ``doc_ord``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_ord")))


def ideal(rows: DataFrame) -> DataFrame:
    """Add ``ideal_rank``: documents of a query by falling label."""
    return rows.withColumn("ideal_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"), "doc_ord")))


def gain(rank: str, n: int) -> Column:
    return F.sum(F.when(F.col(rank) <= n, (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col(rank) + 1.0)).otherwise(F.lit(0.0)))


#: name -> n -> aggregate over a query's ranked rows; more can be passed to :func:`evaluate_ranking`.
RANKING: dict[str, Callable[[int], Column]] = {
    "dcg": lambda n: gain("rank", n),
    "mrr": lambda n: F.coalesce(F.max(F.when((F.col("label") >= 1) & (F.col("rank") <= n), 1.0 / F.col("rank"))), F.lit(0.0)),
    "ndcg": lambda n: F.when(gain("ideal_rank", n) > 0, gain("rank", n) / gain("ideal_rank", n)).otherwise(F.lit(0.0)),
    "precision": lambda n: F.sum(F.when((F.col("label") >= 1) & (F.col("rank") <= n), 1.0).otherwise(0.0)) / n,
}


def ranking(rows: DataFrame, metric: str | Callable[[int], Column], cutoffs: tuple[int, ...], name: str | None = None) -> DataFrame:
    """Mean over queries of a metric at each cutoff, one column each; a query without relevant documents counts 0."""
    fn, name = (RANKING[metric], metric) if isinstance(metric, str) else (metric, name or "metric")
    ready = ideal(ranked(rows))
    per_query = ready.groupBy("query_id").agg(*(fn(n).alias(f"{name}_{n}") for n in cutoffs))
    return per_query.agg(*(F.avg(F.coalesce(f"{name}_{n}", F.lit(0.0))).alias(f"{name}_{n}") for n in cutoffs))


def evaluate_ranking(rows: DataFrame, prefix: str = "test_", cutoffs: tuple[int, ...] = (1, 3, 5, 10), extra: dict[str, Callable[[int], Column]] | None = None) -> DataFrame:
    """DCG at all cutoffs and MRR at 10 (and ``extra`` metrics at 10) in one row."""
    ready = ideal(ranked(rows))
    found = {f"dcg_{n}": RANKING["dcg"](n) for n in cutoffs} | {"mrr_10": RANKING["mrr"](10)} | {f"{k}_10": f(10) for k, f in (extra or {}).items()}
    per_query = ready.groupBy("query_id").agg(*(c.alias(k) for k, c in found.items()))
    return per_query.agg(*(F.avg(F.coalesce(k, F.lit(0.0))).alias(prefix + k) for k in found))
