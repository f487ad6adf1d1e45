"""Key-level operators: compression profiles and keys that training never saw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compression_profile(ids: DataFrame, key: str, bucket: Column, exact: bool = True) -> DataFrame:
    """For each bucket of a compressed key the rows and distinct ids that fall in it."""
    distinct = F.countDistinct(key) if exact else F.approx_count_distinct(key)
    return ids.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), distinct.alias("ids"))


def cold_start(evaluated: DataFrame, trained: DataFrame, key: str) -> DataFrame:
    """Keys to be scored that training never saw."""
    return evaluated.select(key).distinct().join(trained.select(key).distinct(), key, "left_anti")


def rank_pairs(impressions: DataFrame) -> DataFrame:
    """Each rank of a session with each earlier rank, and with 0 for none."""
    k = impressions.select("session_id", "position")
    earlier = k.select("session_id", F.col("position").alias("earlier"))
    pairs = k.join(earlier, "session_id").where("earlier < position")
    return pairs.union(k.select("session_id", "position", F.lit(0).alias("earlier")))


def key_sketches(ids: DataFrame, key: str, bucket: Column, precision: int = 12) -> DataFrame:
    """For each fine bucket its rows and a sketch of its distinct ids (2 ** ``precision`` registers): the one pass over the ids."""
    return ids.groupBy(bucket.alias("fine")).agg(F.count("*").alias("rows"), F.hll_sketch_agg(key, precision).alias("sketch"))


def compression_sweep(sketches: DataFrame, factors: list[int]) -> DataFrame:
    """``factor, bucket, rows, ids`` for each setting that joins ``factor`` neighbouring fine buckets into one; ``ids`` is estimated
    from merged sketches, so that no setting reads the ids again."""
    each = sketches.select("fine", "rows", "sketch", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    merged = each.groupBy("factor", F.expr("fine div factor").alias("bucket")).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("factor", "bucket", "rows", F.hll_sketch_estimate("sketch").alias("ids"))
