"""Session logs: one row is a result page with parallel arrays. Readers, slices and the impressions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_SESSIONS = "query_id long, query_doc_ids array<long>, clicks array<int>"
ID_SESSIONS = "query_doc_ids array<long>, clicks array<int>"
FEATURE_SESSIONS = "query_doc_features array<array<float>>, positions array<int>, clicks array<int>"
ANNOTATIONS = "query_doc_features array<array<float>>, labels array<double>"


#: So many files' starts are broadcast.
FILES_BROADCAST = 500_000


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The Parquet files that a path, folder or glob names, in the order of their names; none is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []
    for status in fs.globStatus(hadoop.Path(pattern)) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [str(f.getPath()) for f in inside if not f.isDirectory() and not f.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(pattern)
    return sorted(found)


def scan(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Read Parquet session files (paths, folders or globs) with an explicit schema; nothing to read is an error."""
    found = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files(spark, p)]
    return spark.read.schema(schema).parquet(*found)


def read_query_sessions(spark: SparkSession, paths: str | list[str], max_positions: int | None = None) -> DataFrame:
    """Sessions of a query: documents by id, ranks 1..n, clicks; cut to the first ranks."""
    rows = scan(spark, paths, QUERY_SESSIONS)
    rows = rows.withColumn("positions", F.sequence(F.lit(1), F.size("query_doc_ids")))
    return first_positions(rows, ["query_doc_ids", "clicks", "positions"], max_positions)


def read_id_sessions(spark: SparkSession, paths: str | list[str], max_positions: int | None = None, min_frequency: int | None = None) -> DataFrame:
    """Sessions without a query; a filter by query frequency is an error, as there is no query."""
    if min_frequency is not None:
        raise ValueError("sessions of this layout have no query to filter by")
    rows = scan(spark, paths, ID_SESSIONS)
    rows = rows.withColumn("positions", F.sequence(F.lit(1), F.size("query_doc_ids")))
    return first_positions(rows, ["query_doc_ids", "clicks", "positions"], max_positions)


def read_feature_sessions(spark: SparkSession, paths: str | list[str], max_positions: int | None = None) -> DataFrame:
    """Sessions with a feature vector for each document and explicit positions; cut by the positions' values."""
    rows = scan(spark, paths, FEATURE_SESSIONS)
    return truncate_by_value(rows, "positions", ["query_doc_features", "clicks"], max_positions) if max_positions else rows


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lists of documents with a feature vector and a graded label each."""
    return scan(spark, paths, ANNOTATIONS)


def first_positions(sessions: DataFrame, arrays: list[str], most: int | None) -> DataFrame:
    return sessions.withColumns({a: F.slice(a, 1, most) for a in arrays}) if most else sessions


def file_starts(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """``(file, first ordinal, rows)`` in file order; rows are counted from the files' footers, by Spark tasks."""
    counts = spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()  # a row for each file
    found, start = [], 0
    for r in sorted(counts):
        found.append((r["f"], start, r["n"]))
        start += r["n"]
    return found


def session_range(spark: SparkSession, paths: str | list[str], begin: int, end: int) -> DataFrame:
    """Sessions ``begin <= ordinal < end`` with their ``ordinal``: files sorted by name, then rows as stored.

    Only files that hold some of the range are read. Files' starts are a small table (a row for each file), broadcast up to
    FILES_BROADCAST files, so that the plan is as small for many files as for one and rows stay where they are read.
    """
    found = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files(spark, p)]
    need = [(f, start) for f, start, n in file_starts(spark, found) if start < end and start + n > begin]
    if not need:
        return spark.read.parquet(*found).withColumn("ordinal", F.lit(0).cast("long")).limit(0)
    rows = spark.read.parquet(*(f for f, _ in need))
    own = rows.columns
    starts = spark.createDataFrame(need, "_file string, _start long")
    starts = F.broadcast(starts) if len(need) <= FILES_BROADCAST else starts
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}).join(starts, "_file")
    rows = rows.withColumn("ordinal", F.col("_start") + F.col("_row")).select(*own, "ordinal")
    return rows.where((F.col("ordinal") >= begin) & (F.col("ordinal") < end))


def session_count(spark: SparkSession, paths: str | list[str], begin: int = 0, end: int | None = None) -> int:
    """How many sessions a slice has, from the files' row counts alone."""
    found = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files(spark, p)]
    total = sum(n for _, _, n in file_starts(spark, found))
    return max(0, min(total, total if end is None else end) - begin)


def explode(sessions: DataFrame, arrays: dict[str, str], keep: list[str], max_positions: int | None = None) -> DataFrame:
    """Impressions with ranks 1..n: ``arrays`` maps array columns to the names of their elements."""
    cut = {a: F.slice(a, 1, max_positions) if max_positions else F.col(a) for a in arrays}
    zipped = F.arrays_zip(*(c.alias(arrays[a]) for a, c in cut.items()))
    out = sessions.select(*keep, F.posexplode(zipped).alias("_at", "_item"))
    return out.select(*keep, (F.col("_at") + 1).alias("position"), *(F.col("_item")[name].alias(name) for name in arrays.values()))


def truncate_by_value(sessions: DataFrame, positions: str, arrays: list[str], most: int) -> DataFrame:
    """Keep the first n elements, n being the number of positions (anywhere in the list) that are at most ``most``."""
    n = F.size(F.filter(positions, lambda p: p <= most))
    return sessions.withColumns({a: F.slice(a, F.lit(1), n) for a in [positions, *arrays]})


def pad(values: Column, width: int, fill: Column) -> Column:
    return F.slice(F.concat(values, F.array_repeat(fill, width)), 1, width)


def mask(values: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= F.size(values))


def frequent(sessions: DataFrame, column: str, least: int) -> DataFrame:
    """Values of ``column`` in at least ``least`` sessions, with their count."""
    return sessions.groupBy(column).agg(F.count("*").alias("sessions")).where(F.col("sessions") >= least)


def keep_frequent(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    return rows.join(values.select(column), column, "left_semi")


def weighted(impressions: DataFrame, max_positions: int = 10) -> DataFrame:
    """Cut to the first ranks and add the session length ``n`` and the weight ``w = 1 / n``."""
    cut = impressions.where(F.col("position") <= max_positions)
    n = F.count("*").over(Window.partitionBy("session_id"))
    return cut.withColumn("n", n.cast("int")).withColumn("w", 1.0 / F.col("n"))


def rolling_splits(rows: DataFrame, ordinal: Column, size: int, folds: int = 3, train: float = 0.5, part: float = 0.125) -> DataFrame:
    """A row for each (row, fold) with its ``split``; each fold starts one part later than the one before. Rows are read once."""
    at = ordinal - F.array(*(F.lit(int(size * part * fold)) for fold in range(folds)))[F.col("fold")]
    split = F.when(at < 0, None).when(at < int(size * train), "train").when(at < int(size * (train + part)), "val").when(at < int(size * (train + 2 * part)), "test")
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.withColumn("split", split).where("split is not null")
