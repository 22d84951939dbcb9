from pathlib import Path

import pytest

from bidstream import workspace
from bidstream.dataset import (
    REQUIRED,
    dataset_stats,
    expected_rows,
    load_stats,
    replicate,
    save_stats,
    stats_path,
)
from bidstream.plans import CATALOG
from bidstream.sources.tables import Tables, from_warehouse
from conftest import at
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stats_name_the_real_result_sizes(spark):
    bid = from_warehouse(spark, SF).bid
    stats = dataset_stats(bid.withColumn("key", F.lit("p0"))).first().asDict()
    assert stats["partitions"] == 1
    for name, size in expected_rows(stats).items():
        assert CATALOG[name](Tables(bid)).count() == size, name


def test_one_channel_on_two_days_counts_twice(make):
    t = make([dict(ts=at("10:00:00"), channel="c", url="", auction=1, price=1),
              dict(ts=at("2024-01-02T10:00:00"), channel="c", url="h?channel_id=1", auction=1, price=1)])
    stats = dataset_stats(t.bid.withColumn("key", F.lit(None).cast("string"))).first()
    assert (stats.q16_expected_rows, stats.channels, stats.q17_expected_rows) == (2, 1, 1)
    assert (stats.q21_expected_rows, stats.q21_anchored_rows, stats.partitions) == (1, 0, 0)


def test_stats_path():
    assert stats_path("/a/foo.keyed.jsonl") == "/a/foo.keyed.stats.json"
    assert stats_path("/a/foo") == "/a/foo.stats.json"


def test_save_and_load(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid.withColumn("key", F.lit("p0"))
    dataset = str(tmp_path / "bids.jsonl")
    save_stats(dataset_stats(bid), dataset)
    assert load_stats(spark, dataset)["total_rows"] == 6000


def test_load_rejects_incomplete_and_unpartitioned(spark, tmp_path):
    one = spark.range(1)
    save_stats(one.select(F.lit(1).alias("total_rows")), str(tmp_path / "a.jsonl"))
    with pytest.raises(ValueError, match="partitions"):
        load_stats(spark, str(tmp_path / "a.jsonl"))
    save_stats(one.select(*[F.lit(0).alias(n) for n in REQUIRED]), str(tmp_path / "b.jsonl"))
    with pytest.raises(ValueError, match="partitions = 0"):
        load_stats(spark, str(tmp_path / "b.jsonl"))


def test_replicate(spark):
    rows = spark.range(100).select(F.concat(F.lit("p"), F.col("id") % 4).alias("key"))
    spread = replicate(rows, 4)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 100


def test_replicate_spreads_a_key_over_parts(spark):
    """Four keys in sixteen parts: none is empty, and none holds a whole key."""
    rows = spark.range(8_000).select(F.concat(F.lit("p"), F.col("id") % 4).alias("key"), "id")
    parts = replicate(rows, 16).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 1_000


def test_clear_deletes_what_was_staged(spark, monkeypatch):
    monkeypatch.setattr(workspace, "_made", [])
    path = workspace.fresh(spark, "short-lived")
    spark.range(3).write.parquet(path)
    workspace.clear(spark)
    assert not Path(path).exists() and not workspace._made
