"""Whole and right results when a third of all rows share one key."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of the events belong to one user and carry one part number, a third of
    the order lines to one part."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    hot = F.col("event_id") % 3 == 0
    events.withColumns(
        {
            "user_id": F.when(hot, 1).otherwise(F.col("user_id")),
            "props": F.when(F.col("event_id") % 6 < 2, '{"k": 5}').otherwise(F.col("props")),
        }
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn(
        "l_partkey", F.when(F.col("l_orderkey") % 3 == 0, 105).otherwise(F.col("l_partkey"))
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{SF}/part.parquet").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.fixture(scope="module")
def con(skewed):
    con = duck(skewed)
    for t in os.listdir(skewed):
        name = t.removesuffix(".parquet")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{skewed}/{t}/*.parquet'")
    return con


@pytest.mark.parametrize(
    "name",
    [
        "features",
        "scored_videos",
        "sku_risk_mart",
        "top_videos_per_sku",
        "alerts_new",
        "decision_outcomes",
        "cooldown",
        "lift_label",
        "dq_report",
        "eval_metrics",
    ],
)
def test_query(spark, skewed, con, name):
    assert compare(spark, con, skewed, name) == ""
