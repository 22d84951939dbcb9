from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bids_while_open(bid: DataFrame, auction: DataFrame) -> DataFrame:
    """Each bid with its auction, where the bid falls in [date_time, expires], both ends included.

    An equi-join on the auction id with the time range as a residual condition. A hot auction is
    split across tasks by the adaptive skew join (see ``session.SETTINGS``).
    """
    return bid.join(
        auction,
        (bid["auction"] == auction["id"])
        & bid["ts"].between(auction["date_time"], auction["expires"]),
    )


def winning_bids(bid: DataFrame, auction: DataFrame, highest: bool = True) -> DataFrame:
    """One in-time bid per auction: the highest (or lowest) price, then the earliest.

    Returns the auction columns plus auction, bidder, price and bid_date_time.
    """
    matched = bids_while_open(bid.select("auction", "bidder", "price", "ts"), auction)
    return best_match(matched, auction.columns, ["id"], highest)


def best_match(matched: DataFrame, auction_columns, by, highest: bool = True) -> DataFrame:
    """The winner among matched rows with equal ``by`` columns.

    Written as a minimum over an ordering struct rather than ``row_number``: an aggregate keeps
    its partial step below the shuffle that a split hot auction needs, a window does not.
    """
    carried = [c for c in auction_columns if c not in by]
    price = -F.col("price") if highest else F.col("price")
    best = matched.groupBy(*by).agg(
        F.min(
            F.struct(
                price.alias("_order"),
                F.col("ts").alias("bid_date_time"),
                "bidder",
                F.struct(*carried).alias("_auction"),
            )
        ).alias("_win")
    )
    won = F.col("_win._order")
    return best.select(
        *by,
        *[F.col(f"_win._auction.{c}").alias(c) for c in carried],
        F.col("id").alias("auction"),
        F.col("_win.bidder").alias("bidder"),
        (-won if highest else won).alias("price"),
        F.col("_win.bid_date_time").alias("bid_date_time"),
    )
