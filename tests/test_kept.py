"""Joins whose sides are kept in stores: every pair once, whichever side comes first, also after a stop."""

import pytest
from pyspark.errors import StreamingQueryException

from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.schemas import AUCTION, BID
from bidstream.sinks import store
from bidstream.sources.tables import Tables
from bidstream.streaming import FORMS, result, start
from conftest import at
from test_streams import same

P = Params()


@pytest.fixture(scope="module")
def tables(make):
    """Ids 0 to 9, two with several auctions or none, and a null one."""
    auction = [dict(id=i % 11 if i < 14 else None, seller=i, category=10 + i % 2, date_time=at("10:00:00"), expires=at("11:00:00"), reserve=i)
               for i in range(15)]
    bid = [dict(auction=i % 13 if i % 17 else None, bidder=i % 5, price=i % 23, ts=at(f"10:{i % 60:02d}:00"), url=f"u{i}") for i in range(300)]
    return make(bid, auction)


def streams(spark, folder):
    """One file of each table a micro-batch."""
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    return Tables(read.schema(BID).parquet(f"{folder}/bid"), read.schema(AUCTION).parquet(f"{folder}/auction"))


@pytest.fixture
def folder(tables, tmp_path):
    """Bids and auctions of an id lie in different files, so that either may come first."""
    for n in range(3):
        tables.bid.where(f"pmod(coalesce(price, 0), 3) = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "bid"))
        tables.auction.where(f"pmod(reserve, 3) = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "auction"))
    return str(tmp_path)


def run(spark, name, folder, fan=8):
    query = start(FORMS[name], streams(spark, folder), f"{folder}/store", f"{folder}/cp", P, fan=fan)
    query.awaitTermination()
    return query


def answer(spark, name, folder):
    return result(FORMS[name], streams(spark, folder), spark, f"{folder}/store", P)


@pytest.mark.parametrize("name", ["q4", "q9", "q20"])
def test_no_row_goes_through_a_state_store(spark, tables, folder, name):
    query = run(spark, name, folder, fan=2)
    progress = query.recentProgress
    assert len(progress) >= 3 and not any(p["stateOperators"] for p in progress)
    assert same(answer(spark, name, folder), CATALOG[name](tables, P))


@pytest.mark.parametrize("commits", [1, 2, 3, 5])
def test_pairs_come_once_after_a_stop(spark, tables, folder, monkeypatch, commits):
    """Stopped after one side, both sides or also the pairs of a micro-batch are stored."""
    real, done = store.add, []

    def stopping(*given, **more):
        real(*given, **more)
        done.append(1)
        if len(done) == commits:
            raise RuntimeError("stopped")

    monkeypatch.setattr(store, "add", stopping)
    with pytest.raises(StreamingQueryException, match="stopped"):
        run(spark, "q20", folder)
    monkeypatch.setattr(store, "add", real)
    run(spark, "q20", folder)
    assert same(answer(spark, "q20", folder), CATALOG["q20"](tables, P))


def test_a_bound_on_time_keeps_to_state_that_spark_drops(spark, folder):
    bounded = P.but(join_horizon="1 day")
    query = start(FORMS["q20"], streams(spark, folder), f"{folder}/store", f"{folder}/cp", bounded)
    query.awaitTermination()
    assert any(p["stateOperators"] for p in query.recentProgress)
    assert result(FORMS["q20"], streams(spark, folder), spark, f"{folder}/store", bounded).count() > 0
