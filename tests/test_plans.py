"""The plans are the wanted ones: pruned scans, partial top-k, partial aggregation, nothing crossed."""
import pytest
from pyspark.sql import functions as F

from pointlake.operators import changes as C
from pointlake.operators import search as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "points")
    spark.range(100).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0).cast("float"), F.col("id").cast("float")).alias("vector"), F.lit("x").alias("payload"), F.col("id").alias("other")).write.parquet(path)
    return spark.read.parquet(path)


def test_topk_reads_two_columns_and_keeps_k_rows_a_partition(points):
    p = plan(S.topk(points, [1.0, 2.0], 5, "l2"))
    assert "TakeOrderedAndProject" in p and "ReadSchema: struct<id:string,vector:array<float>>" in p and "Exchange" not in p


def test_filters_reach_the_scan(points):
    p = plan(S.topk(points.where("other > 50"), [1.0, 2.0], 5, "l2"))
    assert "PushedFilters: [IsNotNull(other), GreaterThan(other,50)]" in p


def test_batches_limit_groups_before_the_shuffle(points):
    p = plan(S.batch_topk(points, points.limit(3).select(F.col("id").alias("qid"), "vector"), 2, "cosine"))
    assert p.count("WindowGroupLimit") == 2 and "MapInArrow" in p and "NestedLoopJoin" not in p and "CartesianProduct" not in p and p.count("Exchange hashpartitioning") == 1


def test_tombstones_are_counted_without_a_window(spark):
    from .test_changes import store

    wal, segments, manifests, _ = store(spark)
    p = plan(C.count_with_tombstones(wal, segments, manifests))
    assert "Window" not in p and "NestedLoop" not in p


def test_changes_are_reduced_before_each_shuffle(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.struct(F.col("id").alias("a")).alias("order"), F.lit("upsert").alias("op"), F.col("id").alias("value"))
    p = plan(C.apply_changes(None, rows, ("id",), F.floor(F.col("order.a") / 4)))
    assert p.count("partial_max_by") == 2 and p.count("Exchange hashpartitioning") == 2
