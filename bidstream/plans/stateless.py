"""Row-at-a-time queries; each serves batch and streaming frames alike."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.functions import (
    channel_code,
    count_char,
    day_of,
    has_channel_id,
    is_named,
    minute_of,
    part_of_day,
    path_part,
    path_part_or_null,
)
from bidstream.params import Params
from bidstream.sources.tables import Tables

QUERIES = (
    "q0", "q0_r", "q1", "q1_r", "q1_r_both", "q2", "q2_r", "q10", "q14", "q14_r",
    "q21", "q21_r", "q21_r_anywhere", "q21_r_timed", "q22", "q22_r", "q22_r_timed",
)

def q0(t: Tables, p: Params = Params()) -> DataFrame:
    """Pass-through."""
    return t.bid.select("auction", "bidder", "price", F.col("ts").alias("date_time"))


def q0_r(t: Tables, p: Params = Params()) -> DataFrame:
    return t.bid.select("auction", "bidder", "price", "channel", "url", "ts")


def q1(t: Tables, p: Params = Params()) -> DataFrame:
    """Currency conversion in decimals."""
    return t.bid.select("auction", "bidder", _converted(p).alias("price"), F.col("ts").alias("date_time"))


def q1_r(t: Tables, p: Params = Params()) -> DataFrame:
    """Currency conversion in doubles."""
    return t.bid.select("auction", "bidder", _euros(p), "channel", "url", "ts")


def q1_r_both(t: Tables, p: Params = Params()) -> DataFrame:
    """As q1_r, keeping the original price next to the converted one."""
    return t.bid.select("auction", "bidder", "price", _euros(p), "channel", "url", "ts")


def q2(t: Tables, p: Params = Params()) -> DataFrame:
    """Bids on a few watched auctions."""
    return _watched(t, p).select("auction", "price")


def q2_r(t: Tables, p: Params = Params()) -> DataFrame:
    return _watched(t, p).select("auction", "price", "ts")


def q10(t: Tables, p: Params = Params()) -> DataFrame:
    """Bids with the day and minute columns that partition the file sink."""
    return t.bid.select(
        "auction", "bidder", "price", F.col("ts").alias("date_time"),
        day_of("ts").alias("date"), minute_of("ts").alias("time"),
    )


def q14(t: Tables, p: Params = Params()) -> DataFrame:
    """Converted price within an open range, part of day, and a character count."""
    low, high = p.converted_range
    return (
        t.bid.withColumn("price", _converted(p))
        .where((F.col("price") > low) & (F.col("price") < high))
        .select(
            "auction", "bidder", "price",
            part_of_day("ts").alias("bidTimeType"),
            F.col("ts").alias("date_time"),
            count_char("extra", "c").alias("c_counts"),
        )
    )


def q14_r(t: Tables, p: Params = Params()) -> DataFrame:
    low, high = p.converted_range
    return (
        t.bid.withColumn("price", F.col("price").cast("double") * float(p.dollar_rate))
        .where((F.col("price") > low) & (F.col("price") < high))
        .select("auction", "bidder", "price", part_of_day("ts").alias("bid_time_type"), "ts", "extra")
    )


def q21(t: Tables, p: Params = Params()) -> DataFrame:
    """Channel code by name or from the URL; bids with neither are dropped."""
    return _with_channel_code(t, anchored=True)


def q21_r(t: Tables, p: Params = Params()) -> DataFrame:
    return _with_channel_code(t, anchored=True)


def q21_r_anywhere(t: Tables, p: Params = Params()) -> DataFrame:
    """As q21_r, accepting ``channel_id=`` after any character."""
    return _with_channel_code(t, anchored=False)


def q21_r_timed(t: Tables, p: Params = Params()) -> DataFrame:
    """As q21_r_anywhere, with the time of the bid."""
    return _with_channel_code(t, False, "ts")


def q22(t: Tables, p: Params = Params()) -> DataFrame:
    """Three URL directories; '' where the URL is too short."""
    return t.bid.select(
        "auction", "bidder", "price", "channel",
        *[path_part("url", 3 + n, last=6).alias(f"dir{n}") for n in (1, 2, 3)],
    )


def q22_r(t: Tables, p: Params = Params()) -> DataFrame:
    """Three URL directories; NULL where the URL is too short."""
    return t.bid.select(
        "auction", "bidder", "price", "channel",
        *[path_part_or_null("url", 2 + n, last=6).alias(f"dir{n}") for n in (1, 2, 3)],
    )


def q22_r_timed(t: Tables, p: Params = Params()) -> DataFrame:
    """Three URL directories, '' where the URL is too short, with the time of the bid."""
    return t.bid.select(
        "auction", "bidder", "price", "channel",
        *[path_part("url", 3 + n, last=6).alias(f"dir{n}") for n in (1, 2, 3)],
        "ts",
    )


def _converted(p):
    return (F.lit(p.dollar_rate) * F.col("price")).cast("decimal(24,3)")


def _euros(p):
    return (F.col("price").cast("double") * p.euro_rate).alias("price_eur")


def _watched(t, p):
    return t.bid.where(F.col("auction").isin(*p.watched_auctions))


def _with_channel_code(t, anchored, *more):
    channel, url = F.col("channel"), F.col("url")
    return t.bid.where(is_named(channel) | has_channel_id(url, anchored)).select(
        "auction", "bidder", "price", "channel",
        channel_code(channel, url, anchored).alias("channel_id"), *more,
    )
