"""Statistics reports: q15, q16, q17 and the flat-bid forms of the last two.

Each report is built from mergeable rows, in three steps:

* ``partial``  reduces bids to one row per (report group, counted id)
* ``merge``    combines partial rows with equal keys, e.g. from several micro-batches
* ``finish``   turns merged rows into the report

so distinct counts become plain counts of rows. Bids are expanded twice (once per counted id
column) where separate distinct aggregates would expand them nine times, and a hot group or id
is reduced by map-side partial aggregation before any shuffle. Days and minutes are aggregated as
dates and numbers, which Spark can hash, and become text in ``finish``.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.functions import day_of, minute_number, minute_text
from bidstream.params import Params
from bidstream.sources.tables import Tables

QUERIES = ("q15", "q16", "q16_r", "q17", "q17_r")

_RANKS = (1, 2, 3)


@dataclass(frozen=True)
class Report:
    partial: Callable[[DataFrame, Params], DataFrame]
    keys: tuple[str, ...]
    merges: dict[str, Callable]
    finish: Callable[[DataFrame], DataFrame]

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(
            *[how(name).alias(name) for name, how in self.merges.items()]
        )

    def batch(self, bid: DataFrame, p: Params) -> DataFrame:
        return self.finish(self.partial(bid, p))


def in_band(price, bands, rank):
    low, high = bands
    price = F.col(price)
    return {1: price < low, 2: (price >= low) & (price < high), 3: price >= high}[rank]


def per_counted_id(bid: DataFrame, groups) -> DataFrame:
    """Each bid twice: once under its bidder, once under its auction."""
    columns = bid.select(*groups, "price", "bidder", "auction")
    return columns.unpivot(columns.columns[:-2], ["bidder", "auction"], "kind", "id")


def band_counts(p: Params):
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(in_band("price", p.price_bands, r)).alias(f"n{r}") for r in _RANKS],
    ]


def band_report(kept: list):
    """Totals and per-band counts of bids, bidders and auctions from (kind, id) rows."""
    bids = F.col("kind") == "bidder"

    def ids(kind, n):
        return F.count_if((F.col("kind") == kind) & F.col("id").isNotNull() & (F.col(n) > 0))

    return [
        *kept,
        F.sum(F.when(bids, F.col("n"))).alias("total_bids"),
        *[F.sum(F.when(bids, F.col(f"n{r}"))).alias(f"rank{r}_bids") for r in _RANKS],
        ids("bidder", "n").alias("total_bidders"),
        *[ids("bidder", f"n{r}").alias(f"rank{r}_bidders") for r in _RANKS],
        ids("auction", "n").alias("total_auctions"),
        *[ids("auction", f"n{r}").alias(f"rank{r}_auctions") for r in _RANKS],
    ]


_BAND_MERGES = {"n": F.sum, **{f"n{r}": F.sum for r in _RANKS}}


def _day_partial(bid, p):
    rows = per_counted_id(bid, [F.to_date("ts").alias("day")])
    return rows.groupBy("day", "kind", "id").agg(*band_counts(p))


DAY_REPORT = Report(
    partial=_day_partial,
    keys=("day", "kind", "id"),
    merges=_BAND_MERGES,
    finish=lambda rows: rows.groupBy("day").agg(*band_report([])).withColumn("day", day_of("day")),
)


def _channel_day_partial(bid, p):
    rows = per_counted_id(
        bid, ["channel", F.to_date("ts").alias("day"), minute_number("ts").alias("minute")]
    )
    return rows.groupBy("channel", "day", "kind", "id").agg(
        F.max("minute").alias("minute"), *band_counts(p)
    )


CHANNEL_DAY_REPORT = Report(
    partial=_channel_day_partial,
    keys=("channel", "day", "kind", "id"),
    merges={"minute": F.max, **_BAND_MERGES},
    finish=lambda rows: rows.groupBy("channel", "day").agg(
        *band_report([minute_text(F.max("minute")).alias("minute")])
    ).withColumn("day", day_of("day")),
)

_PRICE_MERGES = {
    "n": F.sum, "min_price": F.min, "max_price": F.max, "sum_price": F.sum, "priced": F.sum,
}


def price_summary():
    return [
        F.count(F.lit(1)).alias("n"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("price").alias("sum_price"),
        F.count("price").alias("priced"),
    ]


def _mean(rows_filter=None):
    """Average from exact partial sums; decimals, since a report group may exceed a bigint."""
    total, n = F.col("sum_price").cast("decimal(38,0)"), F.col("priced")
    if rows_filter is not None:
        total, n = F.when(rows_filter, total), F.when(rows_filter, n)
    return (F.sum(total).cast("double") / F.nullif(F.sum(n), F.lit(0))).alias("avg_price")


def _channel_partial(bid, p):
    return per_counted_id(bid, ["channel"]).groupBy("channel", "kind", "id").agg(*price_summary())


def _channel_finish(rows):
    bids = F.col("kind") == "bidder"
    return rows.groupBy("channel").agg(
        F.sum(F.when(bids, F.col("n"))).alias("total_bids"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        _mean(bids),
        F.count_if(bids & F.col("id").isNotNull()).alias("distinct_bidders"),
        F.count_if(~bids & F.col("id").isNotNull()).alias("distinct_auctions"),
    )


CHANNEL_REPORT = Report(
    partial=_channel_partial,
    keys=("channel", "kind", "id"),
    merges=_PRICE_MERGES,
    finish=_channel_finish,
)

AUCTION_DAY_REPORT = Report(
    partial=lambda bid, p: bid.groupBy("auction", F.to_date("ts").alias("day")).agg(
        *band_counts(p), *price_summary()[1:]
    ),
    keys=("auction", "day"),
    merges={**_BAND_MERGES, **_PRICE_MERGES},
    finish=lambda rows: rows.select(
        "auction", day_of("day").alias("day"),
        F.col("n").alias("total_bids"),
        *[F.col(f"n{r}").alias(f"rank{r}_bids") for r in _RANKS],
        "min_price", "max_price",
        (F.col("sum_price").cast("double") / F.nullif("priced", F.lit(0))).alias("avg_price"),
        "sum_price",
    ),
)

AUCTION_REPORT = Report(
    partial=lambda bid, p: bid.groupBy("auction", "bidder").agg(*price_summary()),
    keys=("auction", "bidder"),
    merges=_PRICE_MERGES,
    finish=lambda rows: rows.groupBy("auction").agg(
        F.sum("n").alias("bid_count"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        _mean(),
        F.sum("sum_price").alias("sum_price"),
        F.count("bidder").alias("distinct_bidders"),
    ),
)


def q15(t: Tables, p: Params = Params()) -> DataFrame:
    """Per day: bids, bidders and auctions, in total and by price band."""
    return DAY_REPORT.batch(t.bid, p)


def q16(t: Tables, p: Params = Params()) -> DataFrame:
    """As q15 per channel and day, with the latest minute of the day."""
    return CHANNEL_DAY_REPORT.batch(t.bid, p)


def q16_r(t: Tables, p: Params = Params()) -> DataFrame:
    """Per channel: price statistics and two distinct counts."""
    return CHANNEL_REPORT.batch(t.bid, p)


def q17(t: Tables, p: Params = Params()) -> DataFrame:
    """Per auction and day: bids by price band and price statistics."""
    return AUCTION_DAY_REPORT.batch(t.bid, p)


def q17_r(t: Tables, p: Params = Params()) -> DataFrame:
    """Per auction: price statistics and distinct bidders."""
    return AUCTION_REPORT.batch(t.bid, p)
