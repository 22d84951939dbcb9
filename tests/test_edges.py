"""Hand-made rows at the borders of each definition."""

from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bidstream.functions import (
    channel_id,
    count_char,
    matched_group,
    path_part,
    path_part_or_null,
    register_sql_functions,
)
from bidstream.operators import numbered, sessions, take_first
from bidstream.params import Params
from bidstream.plans import CATALOG
from conftest import at, values

Q = CATALOG


def bids(*given):
    return [dict(g, auction=g.get("auction", n), bidder=g.get("bidder", n)) for n, g in enumerate(given)]


def test_channel_id_hit_empty_and_miss(make):
    urls = ["h?query=1", "h?query=1&channel_id=", "h?channel_id=9", "h?a=1&channel_id=7&b=2",
            "channel_id=5", "h?a&channel_id=channel_id=3"]
    t = make(bids(*[dict(channel="x", url=u) for u in urls]))
    assert values(Q["q21"](t), "auction", "channel_id") == [
        (1, ""), (3, "7"), (4, "5"), (5, "channel_id=3")]
    assert values(Q["q21_r_anywhere"](t), "auction", "channel_id") == [
        (1, ""), (2, "9"), (3, "7"), (4, "5"), (5, "channel_id=3")]


def test_channel_names_ignore_case(make):
    t = make(bids(*[dict(channel=c, url="h") for c in ("APPLE", "google", "FaceBook", "baidu", "Channel-1")]))
    assert values(Q["q21"](t), "auction", "channel_id") == [(0, "0"), (1, "1"), (2, "2"), (3, "3")]


def test_missing_path_parts(make):
    t = make(bids(dict(url="https://h"), dict(url="https://h/a"), dict(url="https://h/a//c/d")))
    assert values(Q["q22"](t), "auction", "dir1", "dir2", "dir3") == [
        (0, "", "", ""), (1, "a", "", ""), (2, "a", "", "c")]
    parts = {r.auction: (r.dir1, r.dir2, r.dir3) for r in Q["q22_r"](t).collect()}
    assert parts == {0: (None, None, None), 1: ("a", None, None), 2: ("a", "", "c")}


def test_parts_of_day(make):
    hours = ["06:59:59", "07:00:00", "08:00:00", "18:59:59", "19:00:00", "20:00:00"]
    t = make(bids(*[dict(ts=at(h), price=2_000_000, extra="") for h in hours]))
    assert [v for _, v in values(Q["q14"](t), "auction", "bidTimeType")] == [
        "nightTime", "otherTime", "dayTime", "dayTime", "otherTime", "nightTime"]


def test_converted_range_is_open(make):
    # 0.908 * 250 * 4000 = 908000 and so on; 1e6 / 0.908 is not whole, 250e6 * 0.2 hits none.
    prices = [1_101_321, 1_101_322, 55_066_079, 55_066_080]
    t = make(bids(*[dict(ts=at("09:00:00"), price=p, extra="acc") for p in prices]))
    assert values(Q["q14"](t), "auction", "price", "c_counts") == [
        (1, Decimal("1000000.376"), 2), (2, Decimal("49999999.732"), 2)]
    exact = Params(converted_range=(908, 1816))
    t = make(bids(*[dict(ts=at("09:00:00"), price=p, extra="") for p in (1000, 1001, 1999, 2000)]))
    assert values(Q["q14"](t, exact), "auction") == [(1,), (2,)]


def test_price_bands(make):
    t = make(bids(*[dict(ts=at("09:00:00"), price=p) for p in (9_999, 10_000, 999_999, 1_000_000)]))
    row = Q["q15"](t).first()
    assert (row.total_bids, row.rank1_bids, row.rank2_bids, row.rank3_bids) == (4, 1, 2, 1)
    assert (row.total_bidders, row.rank1_bidders, row.rank2_bidders, row.rank3_bidders) == (4, 1, 2, 1)


def test_null_ids_count_as_bids_but_not_as_ids(make):
    t = make([dict(ts=at("09:00:00"), price=5, channel="c", auction=1),
              dict(ts=at("09:01:00"), price=7, channel="c", bidder=1)])
    day = Q["q16"](t).first()
    assert (day.total_bids, day.total_bidders, day.total_auctions, day.minute) == (2, 1, 1, "09:01")
    flat = Q["q16_r"](t).first()
    assert (flat.total_bids, flat.distinct_bidders, flat.distinct_auctions, flat.avg_price) == (2, 1, 1, 6.0)


def test_bid_range_includes_both_ends(make):
    auction = [dict(id=1, category=10, seller=5, date_time=at("10:00:00"), expires=at("11:00:00"))]
    t = make(
        [dict(auction=1, bidder=n, price=p, ts=at(s)) for n, (p, s) in enumerate(
            [(9, "09:59:59"), (3, "10:00:00"), (5, "11:00:00"), (8, "11:00:01")])],
        auction + [dict(id=2, category=11, seller=5, date_time=at("10:00:00"), expires=at("11:00:00"))],
    )
    assert values(Q["q4"](t), "category", "avg") == [(10, 5.0)]
    assert values(Q["q9"](t), "id", "bidder", "price") == [(1, 2, 5)]
    assert values(Q["q6"](t), "seller", "avg") == [(5, 3.0)]
    assert values(Q["q6_winning"](t), "seller", "avg") == [(5, 5.0)]


def test_equal_prices_go_to_the_earliest_then_smallest_bidder(make):
    auction = [dict(id=1, date_time=at("10:00:00"), expires=at("11:00:00"))]
    t = make([dict(auction=1, bidder=b, price=7, ts=at(s)) for b, s in
              [(4, "10:30:00"), (9, "10:10:00"), (3, "10:10:00")]], auction)
    assert values(Q["q9"](t), "bidder") == [(3,)]


def test_bid_on_window_edge_meets_both_maxima(make):
    # Window maxima: 7 in [:00, :10), 7 in [:10, :20). The second bid is on the edge.
    t = make([dict(auction=1, bidder=1, price=7, ts=at("10:00:05")),
              dict(auction=2, bidder=2, price=7, ts=at("10:00:10")),
              dict(auction=3, bidder=3, price=6, ts=at("10:00:19"))])
    assert values(Q["q7"](t), "auction") == [(1,), (2,), (2,)]


def test_higher_edge_bid_does_not_hide_the_earlier_maximum(make):
    t = make([dict(auction=1, bidder=1, price=7, ts=at("10:00:05")),
              dict(auction=2, bidder=2, price=9, ts=at("10:00:10"))])
    assert values(Q["q7"](t), "auction") == [(1,), (2,)]


def test_hot_items_keep_ties(make):
    p = Params(hop_size="10 seconds", hop_slide="10 seconds")
    t = make([dict(auction=a, ts=at(f"10:00:0{s}")) for a, s in [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)]])
    assert values(Q["q5"](t, p), "auction", "num") == [(1, 2), (2, 2)]


@pytest.mark.parametrize("size,slide,expected", [("10 seconds", "4 seconds", 2), ("10 seconds", "5 seconds", 2)])
def test_sliding_windows_match_spark(spark, make, size, slide, expected):
    t = make([dict(auction=1, ts=at("10:00:03"))])
    mine = Q["q5"](t, Params(hop_size=size, hop_slide=slide)).count()
    theirs = t.bid.select(F.window("ts", size, slide)).count()
    assert mine == theirs >= expected


def test_session_gap(make):
    gaps = ["10:00:00", "10:00:10", "10:00:21"]
    t = make([dict(bidder=1, ts=at(s)) for s in gaps])
    assert values(Q["q11"](t), "bidder", "bid_count") == [(1, 1), (1, 2)]


def test_sessions_equal_session_window(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 7).alias("bidder"),
        F.timestamp_micros((F.pmod(F.xxhash64("id"), F.lit(40_000)) - 20_000) * 250_000).alias("ts"),
    )
    mine = sessions(rows, "bidder", "ts", "3 seconds", "n")
    theirs = (
        rows.groupBy("bidder", F.session_window("ts", "3 seconds").alias("s")).count()
        .select("bidder", F.col("count").alias("n"), "s.start", "s.end")
    )
    assert values(mine, *mine.columns) == values(theirs, *theirs.columns)


def test_trailing_average_across_blocks_and_slices(make):
    start = at("10:00:00")
    auctions = [dict(id=n, seller=1, date_time=start, expires=start + timedelta(hours=9)) for n in range(100)]
    given = [dict(auction=n, bidder=1, price=n * n, ts=start + timedelta(seconds=37 * n)) for n in range(100)]
    t = make(given, auctions)
    expected = sorted(
        sum(x * x for x in range(max(0, n - 10), n + 1)) / len(range(max(0, n - 10), n + 1))
        for n in range(100)
    )
    for block in (3, 7, 1000):
        found = Q["q6"](t, Params(history_block=block))
        assert sorted(r.avg for r in found.collect()) == pytest.approx(expected)


def test_null_seller_is_a_group(make):
    start = at("10:00:00")
    t = make([dict(auction=n, bidder=1, price=n, ts=start) for n in (1, 3)],
             [dict(id=n, date_time=start, expires=start) for n in (1, 3)])
    assert sorted(r.avg for r in Q["q6"](t).collect()) == [1.0, 2.0]


def test_side_table_beyond_broadcast_limit(make):
    t = make(bids(dict(auction=12), dict(auction=7)))
    small, large = Params(side_rows=10), Params(side_rows=10, broadcast_rows=5)
    assert values(Q["q13"](t, small), "auction", "value") == [(7, "7"), (12, "2")]
    assert values(Q["q13"](t, large), "auction", "value") == [(7, "7"), (12, "2")]


def test_count_char_in_sql_and_columns(spark):
    register_sql_functions(spark)
    assert spark.sql("SELECT count_char('abcabcc', 'c')").first()[0] == 3
    assert spark.range(1).select(count_char(F.lit("abcabcc"), "c")).first()[0] == 3


def test_numbering_is_dense_and_ordered(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    found = numbered(rows, ["v", "id"]).collect()
    assert [r.row_index for r in sorted(found, key=lambda r: (r.v, r.id))] == list(range(1000))


def test_numbering_of_equal_rows(spark):
    rows = spark.range(300).select(F.lit(1).alias("v"))
    assert sorted(r.row_index for r in numbered(rows, ["v"]).collect()) == list(range(300))


def test_take_first(spark):
    rows = spark.range(100).select((99 - F.col("id")).alias("v"))
    assert sorted(r.v for r in take_first(rows, ["v"], 10).collect()) == list(range(10))
    with pytest.raises(ValueError):
        take_first(rows, ["v"], 101)


URLS = [None, "", "channel_id=", "&channel_id=&channel_id=2", "a?channel_id=1", "a&channel_id=x/y&z",
        "channel_id=a&channel_id=b", "xchannel_id=1&channel_id=2", "a&&channel_id==&", "&channel_i=3"]


def test_text_search_equals_the_patterns(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string")
    for anchored, pattern, group in ((True, "(&|^)channel_id=([^&]*)", 2), (False, "channel_id=([^&]*)", 1)):
        wrong = rows.where(~channel_id("url", anchored).eqNullSafe(matched_group("url", pattern, group)))
        assert wrong.collect() == []


def test_path_parts_equal_builtin_functions(spark):
    texts = [None, "", "/", "a", "a/b", "a//b/c/d/e/f/g", "https://h/1/2/3/4/5"]
    rows = spark.createDataFrame([(u,) for u in texts], "url string")
    for n in range(1, 7):
        assert rows.where(~path_part("url", n, last=6).eqNullSafe(F.split_part("url", F.lit("/"), F.lit(n)))).isEmpty()
        plain = F.get(F.split("url", "/"), F.lit(n - 1))
        assert rows.where(~path_part_or_null("url", n - 1, last=6).eqNullSafe(plain)).isEmpty()
