"""Joins of buckets: hot ones are joined where their members lie, and every row is there once."""

from __future__ import annotations

from collections import Counter

from meshweave.llm import linking
from pyspark.sql import functions as F


def test_hot_buckets_are_joined_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(linking, "LEAST_HOT", 50)
    hot = spark.range(4000).select(F.lit(-1).cast("bigint").alias("bucket"), F.col("id").alias("node"))
    cold = spark.range(6000).select((F.col("id") % 2000).alias("bucket"), (F.col("id") + 10_000).alias("node"))
    members = hot.union(cold).repartition(8)
    keys = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("bucket <> 7")
    out = linking.join_buckets(members, keys)
    assert out.columns == ["bucket", "node", "pivot"]
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, members.join(keys.drop("n"), "bucket").collect()))
    # the hot bucket's rows stay spread over the members' partitions
    spread = out.where("bucket = -1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 2 * 4000 / 8


def test_no_members(spark):
    members = spark.createDataFrame([], "bucket bigint, node bigint")
    keys = spark.createDataFrame([], "bucket bigint, n bigint, pivot bigint")
    assert linking.join_buckets(members, keys).count() == 0
