"""Readers of the session layouts, slices by footers, result files, and parameters with compressed keys."""

import math
import shutil
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clicklog.functions import keys
from clicklog.operators import models, reports
from clicklog.operators.params import Param, hashed
from clicklog.sources import sessions as S


def written(spark, tmp_path, rows, schema, name):
    """One file for each list of rows, their names in order."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}/part={i}x")
    return f"file://{tmp_path}/{name}/*"


def test_layouts(spark, tmp_path):
    a = written(spark, tmp_path, [[(1, [5, 6, 7], [0, 1, 0])], [(2, [8], [1])]], S.QUERY_SESSIONS, "a")
    out = {r.query_id: (r.query_doc_ids, r.positions, r.clicks) for r in S.read_query_sessions(spark, a, 2).collect()}
    assert out == {1: ([5, 6], [1, 2], [0, 1]), 2: ([8], [1], [1])}
    b = written(spark, tmp_path, [[([5, 6, 7], [0, 1, 0])]], S.ID_SESSIONS, "b")
    assert S.read_id_sessions(spark, b).first().positions == [1, 2, 3]
    with pytest.raises(ValueError, match="query"):
        S.read_id_sessions(spark, b, min_frequency=2)
    c = written(spark, tmp_path, [[([[1.0], [2.0], [3.0]], [1, 9, 2], [0, 1, 1])]], S.FEATURE_SESSIONS, "c")
    assert S.read_feature_sessions(spark, c, 3).first().clicks == [0, 1]  # as many as there are positions up to 3
    d = written(spark, tmp_path, [[([[1.0], [2.0]], [0.0, 4.0])]], S.ANNOTATIONS, "d")
    assert S.read_annotations(spark, d).first().labels == [0.0, 4.0]
    with pytest.raises(FileNotFoundError):
        S.scan(spark, f"file://{tmp_path}/none/*", S.ANNOTATIONS)


def test_slices_read_only_the_files_they_need(spark, tmp_path):
    path = written(spark, tmp_path, [[(i * 10 + j,) for j in range(10)] for i in range(4)], "session long", "s")
    part = S.session_range(spark, path, 8, 21)
    assert {r.ordinal: r.session for r in part.collect()} == {i: i for i in range(8, 21)}
    assert len(part.inputFiles()) == 3
    assert [S.session_count(spark, path, *x) for x in ((0, None), (8, 21), (35, 99), (50, 60))] == [40, 13, 5, 0]
    assert S.session_range(spark, path, 50, 60).count() == 0


def test_slices_of_thousands_of_files_have_a_small_plan(spark, tmp_path):
    for i in range(2000):
        pq.write_table(pa.table({"session": [3 * i, 3 * i + 1, 3 * i + 2]}), tmp_path / f"{i:05d}.parquet")
    part = S.session_range(spark, f"file://{tmp_path}/*.parquet", 1, 5999)
    assert [r.session for r in part.select("session").orderBy("ordinal").collect()] == list(range(1, 5999))
    assert part.where("session <> ordinal").count() == 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 5000 and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_log_follows_its_files(spark, tmp_path):
    from clicklog.plans import data

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "in")
    read = lambda: data.impressions(spark, f"file://{tmp_path}/in")
    before, first = read().count(), read().inputFiles()
    assert read().inputFiles() == first and before > 1000
    lines = pq.read_table(tmp_path / "in/lineitem.parquet")
    (tmp_path / "in/lineitem.parquet").chmod(0o644)
    pq.write_table(lines.slice(0, 1000), tmp_path / "in/lineitem.parquet")
    assert read().count() == 1000 and set(read().inputFiles()).isdisjoint(first)
    assert not any(Path(f.removeprefix("file://").removeprefix("file:")).exists() for f in first)  # the old table is gone


def test_result_files_come_back_with_their_tags(spark, tmp_path):
    rows = [("base_method=hash_ratio=10_seed=3", "pbm", 1.5), ("plain", "dbn", 2.5)]
    reports.write_results(spark.createDataFrame(rows, "experiment string, model string, ppl double"), f"file://{tmp_path}/results")
    out = {r.model: (r.experiment, r.ppl, r.method, r.ratio, r.seed) for r in reports.read_results(spark, f"file://{tmp_path}/results/*/*", "ppl double").collect()}
    assert out == {"pbm": ("base_method=hash_ratio=10_seed=3", 1.5, "hash", 10, 3), "dbn": ("plain", 2.5, None, None, None)}


def test_compressed_parameters_in_a_model(spark):
    log = spark.createDataFrame([(0, k, d, 0, 3, 1 / 3) for k, d in enumerate((11, 12, 13), 1)], "session_id long, position int, query_doc_id long, click int, n int, w double")
    at = log.select("query_doc_id", *(c.alias(n) for c, n in zip(keys.hash_trick(F.col("query_doc_id"), 40), ("bucket", "sign"), strict=True)))
    seen = {r.query_doc_id: (r.bucket, r.sign) for r in at.collect()}
    table = spark.createDataFrame([(b, 0.3 + b) for b in {b for b, _ in seen.values()}], "bucket long, logit double")
    out = models.RateModel(hashed("rate", F.col("query_doc_id"), 40, table)).score(log)
    assert out.columns == [*log.columns, "cond_log_prob", "log_prob", "relevance"]
    for r in out.collect():
        bucket, sign = seen[r.query_doc_id]
        assert r.log_prob == pytest.approx(-math.log1p(math.exp(-sign * (0.3 + bucket))))


def test_compressed_vectors(spark):
    row = spark.range(1).select(
        keys.combined(F.array(F.lit(2.0), F.lit(3.0)), F.array(F.lit(5.0), F.lit(7.0))).alias("p"), keys.combined(F.array(F.lit(2.0)), F.array(F.lit(5.0)), "sum").alias("s"),
        keys.combined(F.array(F.lit(2.0)), F.array(F.lit(5.0)), "concat").alias("c"), keys.gathered(F.array(*(F.lit(float(x)) for x in range(9))), F.array(F.lit(8), F.lit(0), F.lit(1)), F.array(F.lit(-1), F.lit(1), F.lit(1))).alias("g"),
    ).first()
    assert (row.p, row.s, row.c, row.g) == ([10.0, 21.0], [7.0], [2.0, 5.0], [-8.0, 0.0, 1.0])


def test_parameters_from_a_column_and_a_model_of_ones_own(spark):
    log = spark.createDataFrame([(0, 1, 5, 1, 0.7), (0, 2, 6, 0, -0.2)], "session_id long, position int, query_doc_id long, click int, feature double")
    a, t = Param("attraction", fixed=2 * F.col("feature")), Param("examination", fixed=1.0 - F.col("position"))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for r in models.PositionBased(a, t).score(log).collect():
        assert math.exp(r.log_prob) == pytest.approx(sigmoid(2 * r.feature) * sigmoid(1 - r.position))

    class Halved(models.RateModel):
        def unconditional(self, rows):
            return rows.withColumn("log_prob", self.rate.log_prob() - math.log(2))

    assert all(math.exp(r.log_prob) == pytest.approx(sigmoid(2 * r.feature) / 2) for r in Halved(a).score(log).collect())
