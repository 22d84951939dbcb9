"""Ranking, top-k and last-row queries. Orders are made total so that ties are settled."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.operators import top_rows, trailing_average, winning_bids
from bidstream.params import Params
from bidstream.sources.tables import Tables

QUERIES = ("q6", "q6_winning", "q18", "q19")


def q6(t: Tables, p: Params = Params()) -> DataFrame:
    """Per seller, trailing average over the lowest in-time bid of each auction."""
    return seller_average(closing_bids(t, highest=False), p)


def q6_winning(t: Tables, p: Params = Params()) -> DataFrame:
    """As q6 over the highest in-time bid."""
    return seller_average(closing_bids(t, highest=True), p)


def closing_bids(t: Tables, highest: bool) -> DataFrame:
    auction = t.auction.select("id", "seller", "date_time", "expires")
    return winning_bids(t.bid, auction, highest).select("id", "seller", "price", "bid_date_time")


def seller_average(closed: DataFrame, p: Params) -> DataFrame:
    return trailing_average(
        closed, key="seller", order=["bid_date_time", "id"], value="price",
        preceding=p.preceding_rows, block=p.history_block, name="avg",
    )


def q18(t: Tables, p: Params = Params()) -> DataFrame:
    """Last bid of each bidder on each auction."""
    return last_bids(t.bid).select(
        "auction", "bidder", "price", "channel", "url", F.col("ts").alias("date_time")
    )


def last_bids(bid: DataFrame) -> DataFrame:
    order = [F.desc("ts"), F.desc("price"), "channel", "url", "extra"]
    return top_rows(bid, ["bidder", "auction"], order, 1).drop("rank_number")


def q19(t: Tables, p: Params = Params()) -> DataFrame:
    """The highest bids of each auction, ranked."""
    return top_bids(t.bid, p).withColumnRenamed("ts", "date_time")


def top_bids(bid: DataFrame, p: Params) -> DataFrame:
    order = [F.desc("price"), "ts", "bidder", "channel", "url", "extra"]
    return top_rows(bid, ["auction"], order, p.top_k)
