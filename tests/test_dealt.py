"""Tasks whose size does not grow with the table."""

from pyspark.sql import functions as F

from medialens.functions import frames
from medialens.plans import labels
from tests.oracle import difference


def test_regions_meet_once_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(frames, "DEALT", 2000)
    query, sql = labels.QUERIES["object_rollup"]
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(l_orderkey" in plan
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert f", {-(-rows // 2000)}), REPARTITION_BY_NUM" in plan
    assert difference(spark, query, sql, sf_dir) == ""


def test_small_tables_keep_sparks_partitions(spark):
    df = frames.dealt(spark.range(100).withColumn("k", F.col("id") % 3), "k")
    assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 100


def test_unnumbered_regions_are_not_shuffled_for_their_numbers(spark, sf_dir):
    query, sql = labels.QUERIES["blacklist_remap"]
    assert "l_orderkey" not in query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString() and difference(spark, query, sql, sf_dir) == ""
