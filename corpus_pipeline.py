"""A training corpus from ``documents``: language, near-duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

1. language ID: rejected documents go (null texts, texts without a letter, texts below the calibrated score).
2. n-gram join: of each component of similar documents the one with the least doc_id stays. Different texts under
   one doc_id, or under none, are documents of their own.
3. decontamination: documents that hold a benchmark passage go.
4. mixing: a document is repeated for each epoch that takes it; the one in which a source's budget ends stays if
   at least half of its words are taken. Documents that the mix leaves out go.
5. sharding: doc_id, size, text_crc32, law, shard, slot.

Rows with a null doc_id are told apart by their text (and source) in the stages 2 and 4; the other stages pass them as they
are. Equal rows are one document after stage 2. Null and empty texts: the first stage rejects them, the others keep
them, but mixing takes 0 words of them, so they go. Very long texts are read whole; an empty table gives an empty table
at each stage. Extra columns are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklog.llm import decontaminate, language_id, mixing, ngram_join, sharding
from clicklog.llm.store import saved, scratch, small_batches


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = language_id.train(language_id.learnable(docs))
    return language_id.accepted(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # rows are told apart by id and text, so that different texts under one id (or none) are compared like any others
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    found = ngram_join.join_components(keyed.select(F.col("key").alias("doc_id"), "row.text"))
    ids = keyed.select("key", F.col("row.doc_id").alias("id")).distinct()
    members = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids, "key")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    # rows are by key after the join, so that repeated rows of one document meet without another shuffle
    return keyed.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    key = F.xxhash64("doc_id", "text", "source").alias("key")
    taken = mixing.mix(docs.select("doc_id", "text", "source", key)).where("size > 0")
    times = taken.groupBy("key").agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    both = docs.select(F.struct(*docs.columns).alias("row"), key).join(times, "key")
    return both.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("epoch")).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards(docs)


STAGES = [
    ("language_id", by_language),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language ID, the join and the latent search are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:  # a stage's own tables go when its result is written
            docs = saved(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
