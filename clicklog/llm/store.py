"""Tables and components shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: Setting of Spark for the bytes of an Arrow batch, its default, and what texts are sent in.
BATCH_BYTES, UNSET, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of a few MB from now on, unless the session has a size of its own: a batch is held
    several times over, by the JVM and by Python, for each task of an executor."""
    now = spark.conf.get(BATCH_BYTES, None)
    if now is not None and now.rstrip("b") == str(UNSET):
        spark.conf.set(BATCH_BYTES, SMALL)


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_path = path
    if _scopes:
        _scopes[-1].append(back)
    return back


#: Tables written in each open :func:`scratch`, the innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, also after a failure. What the result still reads is put into the
    list that this gives; it is left to the scratch around this one, if there is one."""
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    except BaseException:
        kept.clear()
        raise
    finally:
        inside = _scopes.pop()
        dropped(*(t for t in inside if not any(t is k for k in kept)))
        if _scopes:
            _scopes[-1] += [t for t in inside if any(t is k for k in kept)]


def dropped(*frames: DataFrame | None) -> None:
    """Delete tables written by :func:`saved` that no later result reads."""
    for df in frames:
        path = getattr(df, "saved_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(u, v)`` of longs: ``(node, component)``, the smallest node.

    Alternates large-star and small-star steps until the links no longer change. Each step is a grouped
    minimum joined back, so that a hub with very many links is split by the engine's skew handling.
    Links with a null end are ignored; a link of a node to itself only names the node.
    """
    edges = edges.where("u is not null and v is not null")
    ends = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now, mark = saved(edges.select(*ends).distinct(), "links"), None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = step.union(down.select("u", F.col("m").alias("v")))
        step = saved(step.select(*ends).distinct(), "links")
        sums = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = step
        if sums == mark:
            break
        mark = sums
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def spare(columns: list[str], name: str) -> str:
    """A name like ``name`` that no column has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def gapless(df: DataFrame, key: str, nth: str, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each ``key``, without gathering a key in one task.

    ``nth`` is a column of :func:`pyspark.sql.functions.monotonically_increasing_id` from before ``df`` was written: its
    upper bits name the task that wrote a row. A row's number is its place among its task's rows of the key, after the
    rows of the tasks before. ``df`` is read twice and should be a written table.
    """
    task, count, start, row = (spare(df.columns, n) for n in ("task", "count", "start", "row"))
    df = df.withColumn(task, F.shiftright(nth, 33))
    counts = df.groupBy(key, task).agg(F.count("*").alias(count))
    before = Window.partitionBy(key).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, task, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(key, task).orderBy(nth)
    numbered = df.withColumn(row, F.row_number().over(inside) - 1).join(starts, [key, task])
    return numbered.withColumn(name, (F.col(start) + F.col(row)).cast("long")).drop(task, row, start)


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... over all rows in the order of the columns ``order``, dealt to tasks by range."""
    task, count, start, row = (spare([*df.columns, name], n) for n in ("task", "count", "start", "row"))
    dealt = saved(df.repartitionByRange(*order).withColumn(task, F.spark_partition_id()), "ordered")
    counts = dealt.groupBy(task).agg(F.count("*").alias(count))  # a row for each task
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(task, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(task).orderBy(*order)
    numbered = dealt.withColumn(row, F.row_number().over(inside) - 1).join(F.broadcast(starts), task)
    return numbered.withColumn(name, (F.col(start) + F.col(row)).cast("long")).drop(task, row, start)
