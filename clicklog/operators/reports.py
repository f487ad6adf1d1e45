"""Experiment reports: unions of result tables, leaderboards, spreads, pivots and rank correlation; result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_results(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def leaderboard(results: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    mean = results.groupBy("model").agg(F.avg(metric).alias(metric))
    return mean.orderBy(F.asc(metric) if ascending else F.desc(metric), "model")


def model_means(results: DataFrame, metric: str, by: str = "model") -> DataFrame:
    """Mean, standard deviation, runs and the half width of the 95 % interval."""
    out = results.groupBy(by).agg(F.avg(metric).alias("mean"), F.stddev(metric).alias("sd"), F.count(metric).alias("runs"))
    return out.withColumn("ci", 1.96 * F.col("sd") / F.sqrt("runs"))


def pivot_ratio(results: DataFrame, metric: str, ratios: list) -> DataFrame:
    return results.groupBy("model").pivot("ratio", ratios).agg(F.avg(metric))


def rank_correlation(results: DataFrame, metric: str, full: object, by: list[str], digits: int = 9) -> DataFrame:
    """Kendall's tau-b of the models' order at each ratio against the full setting's, for each group ``by``.

    Values that agree to ``digits`` decimals are ties, so that the order of a sum does not break them.
    """
    results = results.withColumn(metric, F.round(metric, digits))
    base = results.where(F.col("ratio") == full).select(*by, "model", F.col(metric).alias("x"))
    both = results.where(F.col("ratio") != full).select(*by, "ratio", "model", F.col(metric).alias("y")).join(base, [*by, "model"])
    other = both.select(*by, "ratio", F.col("model").alias("model2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = both.join(other, [*by, "ratio"]).where("model < model2")
    dx, dy = F.signum(F.col("x") - F.col("x2")), F.signum(F.col("y") - F.col("y2"))
    sums = pairs.groupBy(*by, "ratio").agg(F.sum(dx * dy).alias("s"), F.sum(F.abs(dx)).alias("nx"), F.sum(F.abs(dy)).alias("ny"))
    return sums.select(*by, "ratio", F.when(F.col("nx") * F.col("ny") > 0, F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def write_results(results: DataFrame, path: str, form: str = "csv") -> None:
    """One folder for each experiment and model."""
    writer = results.write.mode("append").partitionBy("experiment", "model")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Read many result files by glob; experiment and model come from their folders' names, and method, seed and ratio, where
    an experiment's name has them (``name_method=hash_ratio=10_seed=1``), become columns (null without)."""
    rows = spark.read.option("header", True).schema(schema).csv(pattern).withColumn("_file", F.input_file_name())
    tag = lambda name: F.nullif(F.regexp_extract("experiment", rf"(?:^|_){name}=([^_/]+)", 1), F.lit(""))
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = lambda name: plain(plain(F.regexp_extract("_file", rf"/{name}=([^/]+)/", 1)))  # noqa: E731 (a folder's name is escaped, and its url again)
    named = rows.withColumn("experiment", folder("experiment")).withColumn("model", folder("model"))
    named = named.withColumn("method", tag("method")).withColumn("seed", tag("seed").cast("int")).withColumn("ratio", tag("ratio").cast("int"))
    return named.drop("_file")
