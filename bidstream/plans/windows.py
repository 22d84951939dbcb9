"""Queries over sliding, tumbling, session and processing-time windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.functions import hop_starts
from bidstream.operators import rows_at_max, sessions
from bidstream.params import Params
from bidstream.sources.tables import Tables

QUERIES = ("q5", "q7", "q8", "q11", "q12")


def q5(t: Tables, p: Params = Params()) -> DataFrame:
    """The auctions with most bids in each sliding window, ties included.

    The windows are exploded here instead of with ``window()``: that one expands into a node which
    Catalyst optimises differently in the two uses of the counts, and they would not share a
    shuffle.
    """
    starts = hop_starts("ts", p.hop_size, p.hop_slide)
    counts = (
        t.bid.where(F.col("ts").isNotNull())
        .select("auction", F.explode(starts).alias("starttime"))
        .groupBy("auction", "starttime")
        .agg(F.count(F.lit(1)).alias("num"))
    )
    return busiest(counts).select("auction", "num")


def busiest(counts: DataFrame, few: int = 0) -> DataFrame:
    """The auctions of the most bids in each window, with the window; ``few`` as in ``rows_at_max``."""
    return rows_at_max(counts, "starttime", "num", few=few)


def q7(t: Tables, p: Params = Params()) -> DataFrame:
    """The highest bids of each tumbling window, ties included.

    The time range of the definition is closed at both ends, so a bid exactly on a window edge
    is also compared with the maximum of the window that ends there.
    """
    return highest_bids(placed_bids(t.bid, p)).select(
        "auction", "price", "bidder", F.col("ts").alias("date_time")
    )


def placed_bids(bid: DataFrame, p: Params) -> DataFrame:
    """Bids with the end of each window they are compared in."""
    bid = bid.select(
        "auction", "price", "bidder", "ts", F.window("ts", p.tumble_size).alias("w")
    ).select("*", F.col("w.start").alias("opens"), F.col("w.end").alias("closes")).drop("w")
    on_edge = F.col("ts") == F.col("opens")
    return bid.select(
        "auction", "price", "bidder", "ts",
        F.explode(
            F.when(on_edge, F.array("closes", "opens")).otherwise(F.array("closes"))
        ).alias("window_end"),
    )


def highest_bids(placed: DataFrame) -> DataFrame:
    within = F.col("ts") < F.col("window_end")
    return rows_at_max(placed, "window_end", "price", among=within)


def highest_so_far(placed: DataFrame) -> DataFrame:
    """The rows that ``highest_bids`` may still find once more rows have come: the highest inside each window,
    and those on its end that are not below them."""
    inside = placed.where(F.col("ts") < F.col("window_end"))
    best = inside.groupBy("window_end").agg(F.max("price").alias("_best"))
    on_end = placed.where((F.col("ts") >= F.col("window_end")) & F.col("price").isNotNull())
    level = on_end.join(best, "window_end", "left").where(F.col("_best").isNull() | (F.col("price") >= F.col("_best")))
    return rows_at_max(inside, "window_end", "price").unionByName(level.drop("_best"))


def q8(t: Tables, p: Params = Params()) -> DataFrame:
    """People who opened an auction in the window in which they registered."""
    window = F.window("date_time", p.tumble_size).alias("w")
    newcomers = t.person.select("id", "name", window).groupBy("id", "name", "w").agg(F.count(F.lit(1)))
    openers = t.auction.select("seller", window).groupBy("seller", "w").agg(F.count(F.lit(1)))
    return (
        newcomers.select("id", "name", F.col("w").alias("person_w"))
        .join(
            openers.select("seller", F.col("w").alias("auction_w")),
            (F.col("id") == F.col("seller")) & (F.col("person_w") == F.col("auction_w")),
        )
        .select("id", "name", F.col("person_w.start").alias("starttime"))
    )


def q11(t: Tables, p: Params = Params()) -> DataFrame:
    """Bids per bidder session."""
    return sessions(t.bid, "bidder", "ts", p.session_gap, "bid_count")


def q12(t: Tables, p: Params = Params(), p_time=None) -> DataFrame:
    """Bids per bidder and tumbling window of processing time.

    ``p_time`` names a recorded processing-time column; by default it is the time of the run.
    """
    clock = F.current_timestamp() if p_time is None else F.col(p_time)
    return (
        t.bid.select("bidder", F.window(clock, p.tumble_size).alias("w"))
        .groupBy("bidder", "w")
        .agg(F.count(F.lit(1)).alias("bid_count"))
        .select(
            "bidder", "bid_count",
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        )
    )
