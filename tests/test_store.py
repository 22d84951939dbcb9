"""Stores: one manifest at a time, merged in levels, right wherever their writer stops."""

import math
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__ as registry
from bidstream import sinks, workspace
from bidstream.plans import CATALOG
from bidstream.schemas import BID
from bidstream.sinks import store
from bidstream.sinks.stream import latest_snapshot, newest_per_key, upserted
from bidstream.sources.tables import Tables, from_warehouse
from bidstream.streaming import FORMS, result, start
from bidstream.streaming.replay import replay, stage
from conftest import values
from test_streams import same

SF = "/root/testdata/sf0.001"
P = registry.WIDE
KEYED = "key long, value long, batch_id long"


def batch(spark, number, keys=5):
    """Each key in every batch; the newest value is the number of the batch."""
    return spark.range(keys).select(
        F.col("id").alias("key"), F.lit(number).cast("long").alias("value"), F.lit(number).cast("long").alias("batch_id")
    )


def newest(stored):
    return stored.groupBy("key").agg(F.max("value").alias("value"), F.max("batch_id").alias("batch_id"))


def schema(spark):
    return batch(spark, 0).schema


def test_levels_bound_the_store_by_its_keys(spark, tmp_path):
    path, fan, keys = str(tmp_path / "store"), 2, 5
    for number in range(11):
        store.add(batch(spark, number, keys), number, path, "me", newest, fan)
        now = store.current(spark, path)
        levels = [part.level for part in now.parts]
        assert all(levels.count(level) < fan for level in levels)
        found = store.read(spark, path, schema(spark))
        assert found.count() <= keys * (fan - 1) * (1 + math.log(number + 1, fan))
        assert values(newest(found), "key", "value") == [(key, number) for key in range(keys)]
    folders = [p for p in Path(path).iterdir() if p.name.startswith("part=")]
    assert len(list((tmp_path / "store" / "_manifest").glob("*.json"))) <= store.KEPT_VERSIONS
    assert len(folders) <= store.KEPT_VERSIONS * 3


def test_rows_count_once_and_a_store_has_one_writer(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read(spark, path, schema(spark)).count() == 0
    for number in (0, 1, 1, 0):
        store.add(batch(spark, number), number, path, "me")
    assert store.read(spark, path, schema(spark)).count() == 10
    with pytest.raises(ValueError, match="query me"):
        store.add(batch(spark, 2), 2, path, "another")
    with pytest.raises(ValueError, match="at least 2"):
        store.add(batch(spark, 2), 2, path, "me", newest, fan=1)
    store.add(batch(spark, 2).limit(0), 2, path, "me")
    assert store.current(spark, path).last == 2
    assert store.read(spark, path, schema(spark)).count() == 10


@pytest.mark.parametrize("commits", range(5))
def test_a_writer_stopped_before_any_commit(spark, tmp_path, monkeypatch, commits):
    """Stopped between writing a part and naming it, as a batch or as a merge; the next try goes on."""
    path, real, done = str(tmp_path / "store"), workspace.write_text, []

    def stopping(*given):
        if len(done) == commits:
            raise RuntimeError("stopped")
        done.append(real(*given))

    monkeypatch.setattr(workspace, "write_text", stopping)
    reached = -1
    with pytest.raises(RuntimeError, match="stopped"):
        for number in range(4):
            store.add(batch(spark, number), number, path, "me", newest, 2)
            reached = number
    found = store.read(spark, path, schema(spark))
    committed = store.current(spark, path).last
    assert committed in (reached, reached + 1)
    expected = [(key, committed) for key in range(5)] if committed >= 0 else []
    assert values(newest(found), "key", "value") == expected
    monkeypatch.setattr(workspace, "write_text", real)
    for number in range(reached + 1, 4):
        store.add(batch(spark, number), number, path, "me", newest, 2)
    assert values(newest(store.read(spark, path, schema(spark))), "key", "value") == [(key, 3) for key in range(5)]
    listed = {part.folder for v in store._versions(spark, path) for part in store._manifest(spark, path, v).parts}
    assert {p.name for p in Path(path).iterdir() if p.name.startswith("part=")} == listed


def test_a_frame_outlives_a_merge(spark, tmp_path):
    path = str(tmp_path / "store")
    store.add(batch(spark, 0), 0, path, "me", newest, 2)
    before = store.read(spark, path, schema(spark))
    for number in (1, 2, 3):
        store.add(batch(spark, number), number, path, "me", newest, 2)
    assert values(before, "key", "value") == [(key, 0) for key in range(5)]


def test_a_stream_stopped_after_its_commit_goes_on(spark, tmp_path, monkeypatch):
    """The batch is in the store but not in the checkpoint, so Spark runs it again, with state."""
    bid = from_warehouse(spark, SF).bid
    bid.repartition(4).write.parquet(str(tmp_path / "in"))
    rows = (spark.readStream.schema(BID).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            .groupBy("channel").agg(F.count(F.lit(1)).alias("bids")))
    real = store._tidy

    def run():
        writer = sinks.upsert_stream(rows, None, str(tmp_path / "cp"), str(tmp_path / "out"), ["channel"], fan=2)
        writer.trigger(availableNow=True).start().awaitTermination()

    def stopping(spark, path):
        if store.current(spark, path).last == 1:
            raise RuntimeError("stopped")
        real(spark, path)

    monkeypatch.setattr(store, "_tidy", stopping)
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(store, "_tidy", real)
    run()
    got = upserted(spark, str(tmp_path / "out"), rows.schema, ["channel"])
    expected = bid.groupBy("channel").agg(F.count(F.lit(1)).alias("bids"))
    assert values(got, "channel", "bids") == values(expected, "channel", "bids")


def test_newest_row_per_key(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 4, 2), (2, None, 1), (None, 3, 0), (None, 9, 4)], KEYED)
    assert sorted(map(tuple, newest_per_key(rows, ["key"]).collect()), key=str) == [(1, 4), (2, None), (None, 9)]


def test_a_snapshot_holds_its_newest_version_only(spark, tmp_path):
    for number in range(3):
        store.add(batch(spark, number), number, str(tmp_path / "s"), "me", replace=True)
    assert values(latest_snapshot(spark, str(tmp_path / "s"), schema(spark)), "value") == [(2,)] * 5


@pytest.fixture(scope="module")
def staged(spark):
    return stage(from_warehouse(spark, SF), workspace.fresh(spark, "staged"), slices=3, files=4)


@pytest.mark.parametrize("name", ["q4", "q6", "q9", "q9_closing", "q16", "q18", "q19"])
def test_merged_while_running_equals_batch(spark, staged, name):
    answer, query, _ = replay(name, staged, spark, P, fan=2)
    assert query.exception() is None
    assert same(answer, CATALOG[name.removesuffix("_closing")](from_warehouse(spark, SF), P))


def test_a_store_belongs_to_one_checkpoint(spark, tmp_path):
    from_warehouse(spark, SF).bid.select(*BID.fieldNames()).write.parquet(str(tmp_path / "in"))
    tables = Tables(spark.readStream.schema(BID).parquet(str(tmp_path / "in")))
    start(FORMS["q17_r"], tables, str(tmp_path / "store"), str(tmp_path / "cp"), P).awaitTermination()
    with pytest.raises(StreamingQueryException, match="holds the rows of query"):
        start(FORMS["q17_r"], tables, str(tmp_path / "store"), str(tmp_path / "other"), P).awaitTermination()
    assert same(result(FORMS["q17_r"], tables, spark, str(tmp_path / "store"), P),
                CATALOG["q17_r"](from_warehouse(spark, SF), P))
