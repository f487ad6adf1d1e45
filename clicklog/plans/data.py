"""The click log that the registered queries run on, derived from the given tables, and parameters fitted on it."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicklog.operators import models
from clicklog.operators.fit import shared_dir
from clicklog.operators.params import Param, constant, from_rates
from clicklog.sources import sessions as S

MOST = 10
TAU = (0.8, 0.6, 0.3)
GOING = 0.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One impression for each line item: the order is the session, the customer the query, the part the document."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = item.join(order, item["l_orderkey"] == order["o_orderkey"]).withColumn("position", F.row_number().over(place))
    return rows.select(
        F.col("l_orderkey").cast("long").alias("session_id"), F.col("o_custkey").cast("long").alias("query_id"), F.col("l_partkey").cast("long").alias("query_doc_id"),
        "position", (F.col("l_returnflag") == "R").cast("int").alias("click"),
    )


#: Tables of the log that an application has written, with the versions of their inputs, by application and folder.
_written: dict[tuple[str, str], tuple[str, frozenset]] = {}


def versions(spark: SparkSession, sf_dir: str, *names: str) -> frozenset:
    """Path, bytes and time of each file of the tables, as their store lists them."""
    out = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return frozenset(out)


def _forget(spark: SparkSession, name: str) -> None:
    """Drop a table of the log that its inputs have outlived, and its folder."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's impressions with ``n`` and ``w``, written once in an application, dealt and sorted by session.

    The table is bucketed by session, so that windows and groups by session need no exchange. It is written anew, and the
    one before dropped, when a file of its inputs has changed.
    """
    key, now = (spark.sparkContext.applicationId, sf_dir), versions(spark, sf_dir, "lineitem", "orders")
    name, then = _written.get(key, (None, None))
    if name is not None and then != now:
        _forget(spark, name)
        name = None
    if name is None or not spark.catalog.tableExists(name):
        name = f"clicklog_impressions_{uuid.uuid4().hex}"
        size = table(spark, sf_dir, "lineitem").count()  # from footers
        parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 2_000_000), size // 50_000 + 1, 100_000)
        rows = S.weighted(raw_impressions(spark, sf_dir), MOST).repartition(parts, "session_id")
        rows.write.bucketBy(parts, "session_id").sortBy("session_id", "position").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
        _written[key] = name, now
    return spark.table(name)


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each session with its lists, in rank order."""
    rows = raw_impressions(spark, sf_dir)
    item = F.struct("position", "query_doc_id", "click")
    whole = rows.groupBy("session_id", "query_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return whole.select("session_id", "query_id", F.col("_items.query_doc_id").alias("query_doc_ids"), F.col("_items.position").alias("positions"), F.col("_items.click").alias("clicks"))


class Log:
    """Train, validation and test impressions, and smoothed parameter tables of the train part (without every seventh document)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.rows = impressions(spark, sf_dir)
        self.range = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("r")).first()["r"]  # from footers
        # whole numbers, so that the scan skips row groups
        half, most = math.ceil(0.5 * self.range), math.ceil(0.75 * self.range)
        self.train = self.rows.where(F.col("session_id") < half)
        self.validation = self.rows.where((F.col("session_id") >= half) & (F.col("session_id") < most))
        self.test = self.rows.where(F.col("session_id") >= most)
        self.known = self.train.where("query_doc_id % 7 <> 0")
        self.rho = self.train.agg(F.avg("click").alias("rho")).first()["rho"]

    def rate(self, name: str, rows: DataFrame, *keys: str, clicks: str = "click", views: str = "1", flip: bool = False, few: bool = False) -> Param:
        p = (F.sum(F.expr(clicks)) + 1) / (F.sum(F.expr(views)) + 2)
        table = rows.groupBy(*keys).agg((1 - p if flip else p).alias("p"))
        return from_rates(name, table, keys, "p", self.rho, rows=MOST * MOST if few else None)

    def with_last(self, rows: DataFrame) -> DataFrame:
        last = F.max(F.when(F.col("click") == 1, F.col("position"))).over(Window.partitionBy("session_id"))
        return rows.withColumn("is_last", F.coalesce((F.col("click") == 1) & (F.col("position") == last), F.lit(False)).cast("int"))

    @property
    def attraction(self) -> Param:
        return self.rate("attraction", self.known, "query_doc_id")

    @property
    def by_rank(self) -> Param:
        return self.rate("examination", self.train, "position", few=True)

    @property
    def by_cell(self) -> Param:
        return self.rate("drctr", self.known, "query_doc_id", "position")

    @property
    def by_history(self) -> Param:
        return self.rate("history", self.train.withColumn("last_pos", models.last_click_position().cast("int")), "position", "last_pos", few=True)

    @property
    def satisfaction(self) -> Param:
        return self.rate("satisfaction", self.with_last(self.train).where("query_doc_id % 7 <> 0"), "query_doc_id", clicks="is_last", views="click")

    @property
    def continuation(self) -> Param:
        return self.rate("continuation", self.with_last(self.train), "position", clicks="is_last", views="click", flip=True, few=True)

    def model(self, name: str) -> models.ClickModel:
        return {
            "gctr": lambda: models.RateModel(constant("global", self.rho)),
            "rctr": lambda: models.RateModel(self.by_rank),
            "dctr": lambda: models.RateModel(self.attraction),
            "drctr": lambda: models.RateModel(self.by_cell),
            "pbm": lambda: models.PositionBased(self.attraction, self.by_rank),
            "ubm": lambda: models.UserBrowsing(self.attraction, self.by_history),
            "cm": lambda: models.Cascade(self.attraction),
            "dcm": lambda: models.DependentClick(self.attraction, self.continuation),
            "ccm": lambda: models.ClickChain(self.attraction, *TAU),
            "dbn": lambda: models.DynamicBayesian(self.attraction, self.satisfaction, GOING),
            "sdbn": lambda: models.DynamicBayesian(self.attraction, self.satisfaction, 1.0),
            "dbn_global": lambda: models.DynamicBayesian(self.attraction, constant("satisfaction", 0.4), GOING),
            "mixture": lambda: models.Mixture({m: self.model(m) for m in ("dctr", "pbm", "dbn")}, {m: 1 / 3 for m in ("dctr", "pbm", "dbn")}),
        }[name]()


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded lists from the embeddings: 25 queries, grade = label mod 5, relevance order by vec_id."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select((F.col("vec_id") % 25).alias("query_id"), "vec_id", "embedding", (F.col("label") % 5).cast("int").alias("label"), (F.col("label") >= 7).cast("int").alias("click"))
    return rows.withColumn("doc_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")))
