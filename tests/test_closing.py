"""Streams whose state ends with the auction, and salts of hot keys only."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bidstream import workspace
from bidstream.operators.hot_keys import combined, hot_keys, key_sketch
from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.schemas import AUCTION, BID
from bidstream.streaming import FORMS, result, start
from bidstream.streaming.forms import _joined
from bidstream.streaming.replay import replay, stage
from bidstream.streaming.salts import remembered, salted
from conftest import at
from test_streams import same

HOT = 7


@pytest.fixture(scope="module")
def tables(make):
    """Auctions of very different length, one with a third of all bids, bids before and after, and NULLs."""
    auctions = [
        {"id": i, "seller": i % 3, "category": i % 2, "date_time": at(f"00:{i:02d}:00"),
         "expires": at(f"{(i % 5) * 4:02d}:{i:02d}:30"), "item_name": f"item {i}"} for i in range(1, 21)]
    auctions += [{"id": 50, "date_time": at("01:00:00"), "expires": at("00:30:00")}, {"id": 51, "expires": at("01:00:00")}, auctions[0]]
    bids = [{"auction": 1 + n % 22, "bidder": n % 9, "price": (n * 37) % 101, "ts": at(f"{n % 20:02d}:{n % 60:02d}:{n % 59:02d}")} for n in range(400)]
    bids += [{"auction": HOT, "bidder": n, "price": (n * 13) % 97, "ts": at(f"00:{7 + n % 50:02d}:{n % 60:02d}")} for n in range(300)]
    bids += [{"auction": HOT, "price": 5, "ts": None}, {"auction": None, "price": 6, "ts": at("00:10:00")},
             {"auction": 3, "bidder": None, "price": 500, "ts": at("00:03:00")}, {"auction": 3, "bidder": 2, "price": 500, "ts": at("00:03:00")}]
    return make(bid=bids, auction=auctions[:-1] + [auctions[0]])


@pytest.fixture(scope="module")
def staged(spark, tables):
    return stage(tables, workspace.fresh(spark, "staged"), slices=6, files=2)


@pytest.mark.parametrize("name", ["q4", "q6", "q6_winning", "q9"])
def test_closing_equals_batch(tables, staged, spark, name):
    answer, query, _ = replay(f"{name}_closing", staged, spark)
    unique = tables._replace(auction=tables.auction.dropDuplicates())
    assert same(answer, CATALOG[name](unique, Params()))
    # All auctions are closed: what is left belongs to the closing rows.
    left = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
    assert left <= 4 * Params().join_salts * 3 and left < most


def test_state_follows_open_auctions(spark, make, tmp_path):
    """A day of short auctions: the state after any micro-batch holds a few of them, not all."""
    auctions = [{"id": n, "date_time": at(f"{n // 10:02d}:{n % 10 * 6:02d}:00"), "expires": at(f"{n // 10:02d}:{n % 10 * 6 + 5:02d}:00")} for n in range(240)]
    bids = [{"auction": a["id"], "bidder": k, "price": k, "ts": a["date_time"]} for a in auctions for k in range(3)]
    staged = stage(make(bid=bids, auction=auctions), str(tmp_path / "staged"), slices=12, files=1)
    _, query, _ = replay("q9_closing", staged, spark, Params(hot_auctions=()))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) < 240 and sizes[-1] < 20


def test_two_different_auctions_of_one_id_fail(spark, make, tmp_path):
    auctions = [{"id": 1, "category": c, "date_time": at("00:00:00"), "expires": at("01:00:00")} for c in (1, 2)]
    staged = stage(make(bid=[{"auction": 1, "price": 1, "ts": at("00:10:00")}], auction=auctions), str(tmp_path / "staged"), slices=1, files=1)
    with pytest.raises(Exception, match="two different auctions"):
        replay("q4_closing", staged, spark)


def test_both_ends_belong_to_an_auction_and_sessions_that_touch_do_not_mix(spark, make, tmp_path):
    """Bids in a row of microseconds across both ends, an auction of one moment, and auctions back to back."""
    def micros(n):
        return at("01:00:00") + timedelta(microseconds=n)

    auctions = [{"id": 1, "category": 1, "date_time": micros(3), "expires": micros(6)},
                {"id": 2, "category": 2, "date_time": micros(4), "expires": micros(4)}]
    bids = [{"auction": a, "bidder": n, "price": 100 + abs(n - 5), "ts": micros(n)} for a in (1, 2) for n in range(12)]
    tables = make(bid=bids, auction=auctions)
    staged = stage(tables, str(tmp_path / "staged"), slices=3, files=2)
    p = Params(hot_auctions=(), watermark_delay="10 seconds")
    for name in ("q6", "q9"):
        answer, _, _ = replay(f"{name}_closing", staged, spark, p)
        assert same(answer, CATALOG[name](tables, p))


def test_closing_runs_no_python_for_each_auction(spark, staged):
    plan = FORMS["q9_closing"].plan(staged.tables(spark, closing=True), Params())._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "Python" not in plan and "TransformWithState" not in plan


# --- hot keys ------------------------------------------------------------------------------------

def test_sketches_combine_and_find_hot_keys(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, HOT).otherwise(F.col("id") + 100).alias("k"))
    whole = key_sketch(rows, "k", 500)
    halves = key_sketch(rows.where("k % 2 = 0"), "k", 500).unionByName(key_sketch(rows.where("k % 2 = 1"), "k", 500))
    assert hot_keys(whole, 8) == hot_keys(combined(halves, 500), 8) == (HOT,)
    assert hot_keys(key_sketch(rows.limit(0), "k"), 8) == ()


def test_only_hot_keys_are_spread_and_copied(spark):
    bid = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, HOT).otherwise(F.col("id") + 100).alias("auction"), F.col("id").alias("n"))
    auction = spark.range(5_000).select(F.col("id"))
    joined = _joined(bid, "auction", auction, "id", F.lit(True), (HOT,), 8)
    assert joined.count() == 3_000
    parts = bid.withColumn("p", F.expr("1")).count()
    from bidstream.operators.hot_keys import part_of, parts_of

    spread = bid.groupBy("auction").agg(F.count_distinct(part_of("auction", (HOT,), 8, "n")).alias("parts"))
    assert parts == 3_000 and spread.where("parts > 1").collect() == [(HOT, 8)]
    assert auction.select(F.explode(parts_of("id", (HOT,), 8))).count() == 5_000 + 7


@pytest.mark.parametrize("name", ["q3", "q4", "q9", "q20", "q9_closing"])
def test_hot_salts_equal_batch(spark, tables, staged, make, name):
    people = make(person=[{"id": i, "name": f"p{i}", "state": "or", "date_time": at("00:00:00")} for i in range(3)]).person
    known = tables._replace(auction=tables.auction.dropDuplicates(), person=people)
    p = salted(Params(category=1), known, 6)
    assert p.hot_auctions and HOT in p.hot_auctions and p.join_salts == 6
    if name == "q3":
        staged = stage(known, workspace.fresh(spark, "staged"), slices=2, files=2)
    elif name != "q9_closing":
        staged = stage(known._replace(person=None), workspace.fresh(spark, "staged"), slices=2, files=2)
    answer, _, _ = replay(name, staged, spark, p)
    assert same(answer, CATALOG[name.removesuffix("_closing")](known, Params(category=1)))


def test_a_checkpoint_keeps_its_salts(spark, tmp_path):
    path = str(tmp_path / "checkpoint")
    first = Params(join_salts=6, hot_auctions=(1, 2), hot_sellers=())
    assert remembered(spark, first, path) == first
    assert remembered(spark, Params(hot_auctions=(9,)), path) == first
