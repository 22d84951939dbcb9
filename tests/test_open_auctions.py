"""Auctions that close, with the open ones in a store: as with Spark's state, but without a row of state."""

import random
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException

from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.schemas import AUCTION, BID
from bidstream.sinks import store
from bidstream.sources.tables import Tables
from bidstream.streaming import FORMS, result, start
from bidstream.streaming.replay import replay, stage
from bidstream.streaming.salts import salted
from conftest import at
from test_closing import HOT, staged, tables  # noqa: F401
from test_streams import same

P = Params(keep_open=True)


@pytest.fixture
def sizes(monkeypatch):
    """Rows that each micro-batch leaves open."""
    real, found = store.add, []

    def add(rows, batch_id, path, *given, **more):
        real(rows, batch_id, path, *given, **more)
        if path.endswith("-open/open"):
            found.append(store.read(rows.sparkSession, path, rows.schema).where("NOT closed").count())

    monkeypatch.setattr(store, "add", add)
    return found


@pytest.mark.parametrize("name", ["q6", "q9"])
def test_equals_batch_without_state(tables, staged, spark, sizes, name):  # noqa: F811
    answer, query, _ = replay(f"{name}_closing", staged, spark, P)
    unique = tables._replace(auction=tables.auction.dropDuplicates())
    assert same(answer, CATALOG[name](unique, P))
    assert not any(p["stateOperators"] for p in query.recentProgress)
    assert sizes[-1] <= 8 < max(sizes)  # all auctions are closed: what is left belongs to the closing rows


def test_hot_keys_equal_batch(tables, staged, spark):  # noqa: F811
    known = tables._replace(auction=tables.auction.dropDuplicates())
    p = salted(P, known._replace(person=None, auction=known.auction), 6)
    assert HOT in p.hot_auctions
    assert same(replay("q9_closing", staged, spark, p)[0], CATALOG["q9"](known, p))


def test_the_store_follows_open_auctions(spark, make, tmp_path, sizes):
    auctions = [{"id": n, "date_time": at(f"{n // 10:02d}:{n % 10 * 6:02d}:00"), "expires": at(f"{n // 10:02d}:{n % 10 * 6 + 5:02d}:00")} for n in range(240)]
    bids = [{"auction": a["id"], "bidder": k, "price": k, "ts": a["date_time"]} for a in auctions for k in range(3)]
    staged = stage(make(bid=bids, auction=auctions), str(tmp_path / "staged"), slices=4, files=1)
    answer, _, _ = replay("q9_closing", staged, spark, P)
    assert answer.count() == 240 and max(sizes) < 130 and sizes[-1] < 20


def test_both_ends_belong_to_an_auction(spark, make, tmp_path):
    def micros(n):
        return at("01:00:00") + timedelta(microseconds=n)

    auctions = [{"id": 1, "category": 1, "date_time": micros(3), "expires": micros(6)}, {"id": 1, "category": 3, "date_time": micros(7), "expires": micros(9)},
                {"id": 2, "category": 2, "date_time": micros(4), "expires": micros(4)}]
    bids = [{"auction": a, "bidder": n, "price": 100 + abs(n - 5), "ts": micros(n)} for a in (1, 2) for n in range(12)]
    staged = stage(make(bid=bids, auction=auctions), str(tmp_path / "staged"), slices=2, files=2)
    for p in (P, P.but(watermark_delay="10 seconds")):
        answer, _, _ = replay("q4_closing", staged, spark, p)
        # The view keeps one winner per id, as with state.
        assert answer.count() and same(answer, replay("q4_closing", staged, spark, p.but(keep_open=False))[0])


@pytest.mark.parametrize("second", [dict(category=2), dict(date_time=at("00:30:00")), dict(date_time=at("01:00:00"), expires=at("02:00:00"))])
def test_two_different_auctions_of_one_id_fail(spark, make, tmp_path, second):
    first = dict(id=1, category=1, date_time=at("00:00:00"), expires=at("01:00:00"))
    staged = stage(make(bid=[dict(auction=9, price=1, ts=at("00:10:00"))], auction=[first, first | second]), str(tmp_path / "staged"), slices=1, files=1)
    with pytest.raises(StreamingQueryException, match="two different auctions"):
        replay("q4_closing", staged, spark, P)


def unordered(make, folder, seed, batches=4):
    """Rows that come up to several hours early or late, some beyond the watermark."""
    draw = random.Random(seed)
    begin = [60 * draw.randrange(600) for _ in range(24)]
    auctions = [dict(id=n, category=n % 3, date_time=at("00:00:00") + timedelta(seconds=s), expires=at("00:00:00") + timedelta(seconds=s + 60 * draw.randrange(240)))
                for n, s in enumerate(begin)]
    bids = [dict(auction=n % 26, bidder=n, price=draw.randrange(50), ts=at("00:00:00") + timedelta(seconds=draw.randrange(50_000))) for n in range(300)]
    end = [dict(ts=at("2025-01-01T00:00:00")), dict(ts=at("2026-01-01T00:00:00"))]
    end = [dict(auction=-2, price=0, bidder=0) | row for row in end]
    for n in range(batches + 2):
        low, high = n * 50_000 // batches, (n + 1) * 50_000 // batches
        given = [[], []]
        for side, (rows, time) in enumerate(((bids, "ts"), (auctions, "date_time"))):
            for k, r in enumerate(rows):
                shift = (k * 7919 + seed * 31) % 15_000 - 7_000 if k % 3 == 0 else 0
                place = min(max((r[time] - at("00:00:00")).total_seconds() + shift, 0), 49_999)
                if low <= place < high:
                    given[side].append(r)
        if n >= batches:
            given = [[end[n - batches]], []]
        t = make(*given)
        t.bid.coalesce(1).write.mode("append").parquet(f"{folder}/bid")
        t.auction.coalesce(1).write.mode("append").parquet(f"{folder}/auction")


def run(spark, folder, to, p):
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    streams = Tables(read.schema(BID).parquet(f"{folder}/bid"), read.schema(AUCTION).parquet(f"{folder}/auction"))
    start(FORMS["q9_closing"], streams, f"{to}/store", f"{to}/cp", p).awaitTermination()
    return result(FORMS["q9_closing"], streams, spark, f"{to}/store", p)


@pytest.mark.parametrize("delay", ["30 minutes"])
def test_rows_out_of_order_give_what_state_gives(spark, make, tmp_path, delay):
    unordered(make, str(tmp_path), 3)
    p = P.but(watermark_delay=delay)
    kept = run(spark, str(tmp_path), f"{tmp_path}/kept", p)
    assert kept.count() > 5 and same(kept, run(spark, str(tmp_path), f"{tmp_path}/state", p.but(keep_open=False)))


@pytest.mark.parametrize("commits", [6, 11])
def test_winners_come_once_after_a_stop(spark, make, tmp_path, monkeypatch, commits):
    unordered(make, str(tmp_path), 5, batches=1)
    whole = run(spark, str(tmp_path), f"{tmp_path}/whole", P).collect()
    real, done = store.add, []

    def stopping(*given, **more):
        real(*given, **more)
        done.append(1)
        if len(done) == commits:
            raise RuntimeError("stopped")

    monkeypatch.setattr(store, "add", stopping)
    with pytest.raises(StreamingQueryException, match="stopped"):
        run(spark, str(tmp_path), f"{tmp_path}/run", P)
    monkeypatch.setattr(store, "add", real)
    assert whole and sorted(map(str, run(spark, str(tmp_path), f"{tmp_path}/run", P).collect())) == sorted(map(str, whole))


def test_a_checkpoint_keeps_to_where_it_began(spark, make, tmp_path):
    unordered(make, str(tmp_path), 7, batches=1)
    for first in (True, False):
        run(spark, str(tmp_path), f"{tmp_path}/{first}", P.but(keep_open=first))
        with pytest.raises(ValueError, match="keep_open"):
            run(spark, str(tmp_path), f"{tmp_path}/{first}", P.but(keep_open=not first))
