"""Streams over staged time slices give what the batch query gives over the whole table."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__ as registry
from bidstream import workspace
from bidstream.dataset import dataset_stats, expected_rows
from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.schemas import AUCTION, BID, PERSON
from bidstream.sources.events import stream_bids
from bidstream.sources.tables import Tables, from_warehouse
from bidstream.streaming import FORMS, compact, result, start
from bidstream.streaming.forms import _repeated
from bidstream.streaming.metrics import (
    markdown,
    measure,
    metrics_frame,
    report,
    run_and_measure,
    save_report,
)
from bidstream.streaming.replay import replay, stage
from check import normalised
from conftest import at, values

SF = "/root/testdata/sf0.001"
P = registry.WIDE


@pytest.fixture(scope="module")
def staged(spark):
    return stage(from_warehouse(spark, SF), workspace.fresh(spark, "staged"), slices=3, files=4)


def same(left, right):
    columns = sorted(left.columns)
    assert sorted(right.columns) == columns
    return normalised(left.select(*columns).collect()) == normalised(right.select(*columns).collect())


@pytest.mark.parametrize(
    "name",
    ["q0", "q3", "q4", "q5", "q6", "q7", "q8", "q9", "q11", "q13", "q15", "q16", "q16_r", "q17",
     "q17_r", "q18", "q19", "q20", "q21"],
)
def test_equals_batch(spark, staged, name):
    p = registry.HOURLY if name == "q8" else P
    answer, query, _ = replay(name, staged, spark, p)
    assert query.exception() is None
    assert len(query.recentProgress) >= 3
    assert same(answer, CATALOG[name](from_warehouse(spark, SF), p))


def test_processing_time_counts_every_bid(spark, staged):
    answer, _, _ = replay("q12", staged, spark, P)
    assert answer.groupBy().sum("bid_count").first()[0] == 6000


def test_join_is_unbounded_unless_a_horizon_is_given(spark, staged):
    answer, _, _ = replay("q3", staged, spark, P)
    assert same(answer, CATALOG["q3"](from_warehouse(spark, SF), P))
    none = P.but(join_horizon="1 second")
    assert replay("q3", staged, spark, none)[0].count() < answer.count()


def test_restart_continues_and_repeats_nothing(spark, tmp_path):
    bid = from_warehouse(spark, SF).bid.select(*BID.fieldNames())
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for begin in (0, 3000):
        part = bid.where((F.col("auction") % 6000 >= begin / 4) & (F.col("auction") < (begin + 3000) / 4))
        part.write.mode("append").parquet(source)
        tables = Tables(spark.readStream.schema(BID).parquet(source))
        start(FORMS["q19"], tables, f"{folder}/store", f"{folder}/cp", P).awaitTermination()
    assert same(result(FORMS["q19"], tables, spark, f"{folder}/store", P),
                CATALOG["q19"](Tables(spark.read.parquet(source)), P))
    compact(FORMS["q19"], tables, spark, f"{folder}/store", f"{folder}/merged", P)
    assert same(result(FORMS["q19"], tables, spark, f"{folder}/merged", P),
                result(FORMS["q19"], tables, spark, f"{folder}/store", P))
    merged = spark.read.parquet(f"{folder}/merged").count()
    assert merged <= spark.read.parquet(f"{folder}/store").count()


def test_reports_count_late_rows(spark, tmp_path):
    names = ("q15", "q16", "q17")

    def feed(*texts):
        rows = [(at(t), 1, 1, 5, "c", "u", "e") for t in texts]
        spark.createDataFrame(rows, BID).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tables = Tables(spark.readStream.schema(BID).parquet(f"{tmp_path}/in"))
        for name in names:
            start(FORMS[name], tables, f"{tmp_path}/{name}/store", f"{tmp_path}/{name}/cp").awaitTermination()
        return tables

    feed("2024-01-01T10:00:00")
    feed("2024-01-02T00:10:00")
    tables = feed("2024-01-01T23:59:00")     # its day has passed
    for name in names:
        got = result(FORMS[name], tables, spark, f"{tmp_path}/{name}/store")
        assert same(got, CATALOG[name](Tables(spark.read.parquet(f"{tmp_path}/in"))))
        assert dict(values(got, "day", "total_bids")) == {"2024-01-01": 2, "2024-01-02": 1}


_AWKWARD = ("q0", "q3", "q4", "q5", "q6", "q6_winning", "q7", "q8", "q9", "q11", "q15", "q16", "q17", "q20")


@pytest.fixture(scope="module")
def awkward(spark):
    """Long auctions, an id used twice, rows far apart in time, NULL and negative keys, no time."""
    day = "2024-01-0{}T0{}:00:00".format
    person = [(1, "n", "m", "cc", "c", "or", at(day(1, 0)), "e"), (None, "n", "m", "cc", "c", "or", at(day(1, 0)), "e"),
              (-4, "n", "m", "cc", "c", "id", None, "e")]
    auction = [
        (1, "i", "d", 1, 1, at(day(1, 0)), at(day(1, 2)), 1, 10, "e"),
        (1, "i", "d", 1, 1, at(day(1, 1)), at(day(9, 2)), 1, 10, "f"),
        (2, "i", "d", 1, 1, at(day(1, 0)), at(day(8, 0)), -4, None, "e"),
        (-2, "i", "d", 1, 1, at(day(1, 0)), at(day(1, 3)), 1, 11, "e"),
        (None, "i", "d", 1, 1, at(day(1, 0)), at(day(1, 3)), None, 10, "e"),
        (9, "i", "d", 1, 1, at("2024-08-01T00:00:00"), at("2024-08-01T02:00:00"), 1, 10, "e"),
        (3, "i", "d", 1, 1, None, at(day(1, 3)), 1, 10, "e"),
    ]
    bid = [
        (at(day(1, 0)), 1, 5, 10, "c", "u", "e"), (at("2024-01-01T01:30:00"), 1, 6, 99, "c", "u", "e"),
        (at(day(7, 0)), 2, 6, 7, "c", "u", "e"), (at(day(1, 1)), 2, None, 3, "c", "u", "e"),
        (at(day(1, 2)), None, -2, 4, "c", "u", "e"), (at(day(1, 2)), -2, -2, 4, None, "u", "e"),
        (None, 1, 5, 12, "c", "u", "e"), (at("2024-08-01T01:00:00"), 9, 1, 0, "c", "u", "e"),
        (at(day(1, 2)), 1, 7, None, "c", "u", "e"),
    ]
    tables = Tables(*[spark.createDataFrame(rows, schema) for rows, schema in ((bid, BID), (auction, AUCTION), (person, PERSON))])
    return tables, stage(tables, workspace.fresh(spark, "awkward"), slices=3, files=2)


@pytest.mark.parametrize("name", _AWKWARD)
def test_equals_batch_on_awkward_rows(spark, awkward, name):
    tables, staged_ = awkward
    p = registry.HOURLY if name == "q8" else P
    answer, _, _ = replay(name, staged_, spark, p)
    assert same(answer, CATALOG[name](tables, p))


def test_an_auction_beyond_the_bound_fails_the_query(spark, awkward):
    with pytest.raises(StreamingQueryException, match="open for more than"):
        replay("q9", awkward[1], spark, P.but(max_auction_length="1 hour"))


def test_bounded_auctions_give_the_same(spark, staged):
    answer, _, _ = replay("q4", staged, spark, P.but(max_auction_length="1 day"))
    assert same(answer, CATALOG["q4"](from_warehouse(spark, SF), P))


def test_metrics_and_report(spark, staged, tmp_path):
    bid = from_warehouse(spark, SF).bid
    stats = dataset_stats(bid.withColumn("key", F.lit("p0"))).first().asDict()
    measured = []
    for name in ("q2_r", "q22_r"):
        answer, query, seconds = replay(name, staged, spark, P)
        measured.append(measure(name, query, seconds, expected_rows(stats)[name], answer.count()))
    measured.append(dict.fromkeys(measured[0]) | {"query": "skipped", "state": "unsupported"})
    frame = metrics_frame(spark, measured)
    assert values(frame, "query") == [("q22_r",), ("q2_r",), ("skipped",)]
    row = frame.where("query = 'q22_r'").first()
    assert (row.state, row.input_rows, row.inserted_rows) == ("finished", 6000, 6000)
    assert row.throughput_rps == pytest.approx(6000 / row.replay_sec)
    content = report("spark", "local", SF, {}, stats, "table", measured)
    assert set(content) == {"generated_at", "engine", "mode", "fixture", "fixture_metadata",
                            "dataset_stats", "sink_mode", "results"}
    assert "| skipped | unsupported | - |" in markdown(content)
    save_report(spark, content, str(tmp_path))
    assert spark.read.text(str(tmp_path / "report.json")).count() == 1


def test_outcome_tells_missing_rows(spark, staged):
    _, query, seconds = replay("q0", staged, spark, P)
    assert measure("q0", query, seconds, expected=7000, inserted=6000)["state"] == "short"


def test_failed_and_slow_queries_are_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("p0\t{broken\n")

    def begin():
        tables = Tables(stream_bids(spark, str(tmp_path / "in")).drop("key"))
        return start(FORMS["q0_r"], tables, str(tmp_path / "store"), str(tmp_path / "cp"), P)

    assert run_and_measure("q0_r", begin, 60)["state"] == "failed"

    def waiting():
        (tmp_path / "empty").mkdir()
        rows = spark.readStream.schema(BID).parquet(str(tmp_path / "empty"))
        return rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "r")).start()

    assert run_and_measure("waiting", waiting, 2)["state"] == "timeout"


def test_a_query_that_goes_on_is_not_stopped(spark, staged, tmp_path):
    def begin():
        return start(FORMS["q16_r"], staged.tables(spark, False), str(tmp_path / "store"), str(tmp_path / "cp"), P)

    measured = run_and_measure("q16_r", begin, 5)
    assert (measured["state"], measured["input_rows"], measured["batches"]) == ("finished", 6000, 3)


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 25), (3, 10)], "id long, n long")
    counts = _repeated(rows, "n", run=10).groupBy("id").count()
    assert values(counts, "id", "count") == [(1, 1), (2, 25), (3, 10)]
