import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bidstream import sinks, workspace
from bidstream.functions import day_of
from bidstream.plans import CATALOG
from bidstream.schemas import BID, COMBINED_EVENT
from bidstream.session import shuffle_partitions
from bidstream.sinks.batch import keyed
from bidstream.sinks.stream import latest_snapshot, upserted
from bidstream.sources import kafka
from bidstream.sources.events import (
    decode,
    decode_lenient,
    demultiplex,
    multiplex,
    read_bids,
    split_key,
    stream_bids,
    with_watermarks,
)
from bidstream.sources.side_input import side_input
from bidstream.sources.tables import Tables, from_warehouse, stored_bytes
from conftest import at, values

SF = "/root/testdata/sf0.001"
GOOD = '{"ts":"2024-01-01T00:00:01.5Z","auction":1,"bidder":2,"price":3,"channel":"c","url":"u","extra":"e"}'


@pytest.fixture
def lines(spark):
    def given(*texts):
        return spark.createDataFrame([(t,) for t in texts], "value string")

    return given


def test_keyed_and_plain_lines(lines):
    found = split_key(lines(f"p0\t{GOOD}", GOOD, "", "  \t ", "p1\ta\tb")).collect()
    assert [tuple(r) for r in found] == [("p0", GOOD), (None, GOOD), ("p1", "a\tb")]


def test_both_time_formats(spark, lines):
    spaced = GOOD.replace("T00", " 00").replace("Z", "")
    times = decode(split_key(lines(GOOD, spaced))).select(F.unix_micros("ts")).collect()
    assert [r[0] for r in times] == [1_704_067_201_500_000] * 2


def test_strict_decoding_fails(lines):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        decode(split_key(lines(GOOD, "{not json"))).collect()


def test_lenient_decoding_quarantines(lines):
    wrong_type = GOOD.replace('"price":3', '"price":"three"')
    decoded = decode_lenient(split_key(lines(GOOD, "p3\t{not json", wrong_type)))
    assert decoded.rows.select("auction").collect() == [(1,)]
    assert values(decoded.quarantine, "payload") == sorted([("{not json",), (wrong_type,)])
    assert decoded.rows.columns == ["key", *BID.fieldNames()]


def test_combined_stream_round_trip(spark):
    tables = from_warehouse(spark, SF)
    events = multiplex(tables)
    assert events.schema.fieldNames() == COMBINED_EVENT.fieldNames()
    assert values(events.groupBy("event_type").count(), "event_type", "count") == [
        (0, 150), (1, 1500), (2, 6000)]
    split = demultiplex(events)
    for before, after in zip(tables, split):
        assert after.columns == [c for c in after.columns if c in before.columns]
        assert before.select(*after.columns).exceptAll(after).isEmpty()


def test_keyed_lines_round_trip(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid
    sinks.write_keyed_lines(bid, str(tmp_path / "log"), 4)
    back = read_bids(spark, str(tmp_path / "log"))
    assert values(back.groupBy("key").count(), "key", "count") == [(f"p{n}", 1500) for n in range(4)]
    assert bid.select(*BID.fieldNames()).exceptAll(back.drop("key")).isEmpty()
    files = sorted((tmp_path / "log").glob("part-*"))
    written = [line for file in files for line in file.read_text().splitlines()]
    assert [line.split("\t")[0] for line in written] == [f"p{n % 4}" for n in range(6000)]
    times = [json.loads(line.split("\t")[1])["ts"] for line in written]
    assert times == sorted(times) and times[0].endswith("Z")


def test_log_stream_reads_all_and_ends(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid
    sinks.write_keyed_lines(bid, str(tmp_path / "log"), 4)
    rows = CATALOG["q2_r"](Tables(stream_bids(spark, str(tmp_path / "log"), 2)))
    query = sinks.discard_stream(rows, "drain", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    assert sum(p["numInputRows"] for p in query.recentProgress) >= CATALOG["q2_r"](from_warehouse(spark, SF)).count()


def test_side_input(spark):
    assert values(side_input(spark, 3), "key", "value") == [(0, "0"), (1, "1"), (2, "2")]


def test_kafka_options_and_decoding(spark):
    options = kafka.source_options("h:9092", "bids", group="g", offsets_per_trigger=10, min_partitions=8)
    assert options == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "bids", "startingOffsets": "earliest",
        "failOnDataLoss": "true", "kafka.group.id": "g", "maxOffsetsPerTrigger": "10",
        "minPartitions": "8"}
    records = spark.createDataFrame([(b"p0", GOOD.encode())], "key binary, value binary")
    row = kafka.bids_of_records(records).first()
    assert (row.key, row.auction, row.price) == ("p0", 1, 3)


def test_keys_follow_time_order(make):
    t = make([dict(ts=at(f"10:00:0{9 - n}"), auction=n, bidder=1, price=1) for n in range(5)])
    found = {json.loads(r.value)["auction"]: r.key for r in keyed(t.bid, 2).collect()}
    assert found == {4: "p0", 3: "p1", 2: "p0", 1: "p1", 0: "p0"}


def test_partitioned_files(spark, tmp_path):
    tables = from_warehouse(spark, SF)
    rows = CATALOG["q10"](tables).where("hour(date_time) = 1")
    sinks.write_files(rows, str(tmp_path / "out"))
    folders = {f"{p.parent.parent.name}/{p.parent.name}" for p in (tmp_path / "out").rglob("*.parquet")}
    assert folders == {f"date={r.date}/time={r.time.replace(':', '%3A')}" for r in rows.select("date", "time").distinct().collect()}
    back = spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))
    assert rows.exceptAll(back).isEmpty() and back.count() == rows.count()


def test_hash_partitioned_table(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid
    sinks.write_hash_partitioned(bid, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 6000
    assert back.select("bucket").distinct().count() == 4
    assert back.groupBy("auction").agg(F.countDistinct("bucket").alias("n")).where("n > 1").isEmpty()


def test_discard(spark):
    sinks.discard(from_warehouse(spark, SF).bid)


@pytest.fixture
def bid_stream(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid
    bid.repartition(3).write.parquet(str(tmp_path / "bids"))
    return spark.readStream.schema(BID).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bids"))


def drained(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_file_stream(spark, bid_stream, tmp_path):
    rows = bid_stream.where("hour(ts) = 1").select("auction", "price", day_of("ts").alias("date"))
    drained(sinks.file_stream(rows, "files", str(tmp_path / "cp"), str(tmp_path / "out"), by=("date",)))
    expected = from_warehouse(spark, SF).bid.where("hour(ts) = 1").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == expected


def test_materialized_view(spark, bid_stream, tmp_path):
    counts = bid_stream.groupBy("channel").count()
    drained(sinks.snapshot_stream(counts, "view", str(tmp_path / "cp"), str(tmp_path / "out")))
    expected = values(from_warehouse(spark, SF).bid.groupBy("channel").count(), "channel", "count")
    assert values(latest_snapshot(spark, str(tmp_path / "out"), counts.schema), "channel", "count") == expected
    # A version without its commit marker is not read.
    half = tmp_path / "out" / "batch_id=999"
    half.mkdir()
    counts_of = spark.createDataFrame([("nobody", 1)], counts.schema)
    counts_of.write.mode("append").parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert values(latest_snapshot(spark, str(tmp_path / "out"), counts.schema), "channel", "count") == expected


def test_upserts_and_forced_appends(spark, bid_stream, tmp_path):
    counts = bid_stream.groupBy("channel").count()
    drained(sinks.upsert_stream(counts, "changes", str(tmp_path / "cp"), str(tmp_path / "out")))
    expected = values(from_warehouse(spark, SF).bid.groupBy("channel").count(), "channel", "count")
    newest = upserted(spark, str(tmp_path / "out"), counts.schema, ["channel"])
    assert values(newest, "channel", "count") == expected
    # Every change was kept as an insert of its own.
    assert spark.read.parquet(str(tmp_path / "out")).count() > len(expected)


def test_workspace_uses_the_named_folder(spark):
    assert workspace.root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert Path(workspace.fresh(spark, "x")).parent == Path(workspace.root(spark))


def test_shuffle_size_follows_the_input():
    assert shuffle_partitions(1 << 20, 8) == 8
    assert shuffle_partitions(1 << 40, 8) == 16384
    assert shuffle_partitions(100 << 40, 4000) == 100 * 16384


def test_stored_bytes(spark):
    tables = ("lineitem", "orders", "customer")
    assert stored_bytes(spark, SF) == sum(Path(f"{SF}/{t}.parquet").stat().st_size for t in tables)


def test_zoneless_times_can_carry_a_watermark(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid
    zoneless = bid.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    zoneless.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(zoneless.schema).parquet(str(tmp_path / "in"))
    declared = with_watermarks(Tables(stream), "1 minute").bid
    assert dict(declared.dtypes)["ts"] == "timestamp"
    drained(sinks.discard_stream(declared, "zoneless", str(tmp_path / "cp")))
