"""Queries that join bids, auctions, people and the side table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.operators import bids_while_open, lookup_join, winning_bids
from bidstream.params import Params
from bidstream.sources.side_input import side_input
from bidstream.sources.tables import Tables

QUERIES = ("q3", "q4", "q9", "q13", "q20")


def q3(t: Tables, p: Params = Params()) -> DataFrame:
    """Auctions of one category whose seller lives in one of a few states."""
    sellers = t.person.where(F.col("state").isin(*p.states)).select(
        F.col("id").alias("person_id"), "name", "city", "state"
    )
    return (
        t.auction.where(F.col("category") == p.category).select("id", "seller")
        .join(sellers, F.col("seller") == F.col("person_id"))
        .select("name", "city", "state", "id")
    )


def q4(t: Tables, p: Params = Params()) -> DataFrame:
    """Average closing price per category."""
    return average_final(final_prices(t))


def final_prices(t: Tables) -> DataFrame:
    matched = bids_while_open(
        t.bid.select("auction", "price", "ts"),
        t.auction.select("id", "category", "date_time", "expires"),
    )
    return matched.groupBy("id", "category").agg(F.max("price").alias("final"))


def average_final(finals: DataFrame) -> DataFrame:
    return finals.groupBy("category").agg(F.avg("final").alias("avg"))


def q9(t: Tables, p: Params = Params()) -> DataFrame:
    """The winning bid of each auction with the auction's own columns."""
    return winning_bids(t.bid, t.auction.drop("extra"))


def q13(t: Tables, p: Params = Params()) -> DataFrame:
    """Bids with a value looked up in a bounded side table."""
    side = side_input(t.bid.sparkSession, p.side_rows)
    return lookup_join(
        t.bid, side, F.col("auction") % p.side_rows == F.col("key"), p.side_rows, p.broadcast_rows
    ).select("auction", "bidder", "price", F.col("ts").alias("date_time"), "value")


def q20(t: Tables, p: Params = Params()) -> DataFrame:
    """Bids on auctions of one category, widened with the auction's columns."""
    auction = t.auction.where(F.col("category") == p.category).select(
        "id", "item_name", "description", "initial_bid", "reserve",
        F.col("date_time").alias("auction_date_time"), "expires", "seller", "category",
        F.col("extra").alias("auction_extra"),
    )
    bid = t.bid.select(
        "auction", "bidder", "price", "channel", "url",
        F.col("ts").alias("bid_date_time"), F.col("extra").alias("bid_extra"),
    )
    return bid.join(auction, F.col("auction") == F.col("id")).drop("id")
