"""How each query runs on streams.

A form has up to three parts:

* ``build``  the streaming plan, with Spark's own state where it needs any
* ``batch``  what to do with the rows of one micro-batch before they are stored
* ``view``   how to read the query's answer from everything stored so far

Queries whose result Spark can finalise by event time need only ``build`` (append mode). Where
the definition has no time bound, or needs a second unbounded step, micro-batches store small
mergeable rows and ``view`` combines them; nothing is read back or rewritten while the stream
runs, and no state grows inside the stream.

A join of two streams is given by its ``sides``, the larger one first, and the ``pairs`` of them. With a bound
on time Spark's own state holds the sides; without one they are kept in stores (see ``kept``).
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.operators import best_match
from bidstream.operators.hops import hop_panes, merged_panes, window_counts
from bidstream.operators.hot_keys import part_of, parts_of
from bidstream.operators.sessions import joined_slices, merged_slices, session_slices
from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.plans import reports as R
from bidstream.plans.joins import average_final
from bidstream.plans.ranking import last_bids, seller_average, top_bids
from bidstream.plans.windows import busiest, highest_bids, highest_so_far, placed_bids
from bidstream.sources.events import with_watermarks
from bidstream.sources.tables import Tables
from bidstream.streaming.closing import winners


@dataclass(frozen=True)
class Form:
    build: Callable[[Tables, Params], DataFrame]
    batch: Callable[[DataFrame, Params], DataFrame] | None = None
    view: Callable[[DataFrame, Params], DataFrame] | None = None
    merge: Callable[[DataFrame, Params], DataFrame] | None = None
    mode: str = "append"
    # ``build`` declares event time itself.
    declares: bool = False
    # The micro-batch is read more than once; keep it so that state is advanced only once.
    reread: bool = False
    sides: Callable[[Tables, Params], tuple[DataFrame, DataFrame]] | None = None
    pairs: Callable[[DataFrame, DataFrame, Params], DataFrame] | None = None
    bound: Callable[[Params], str | None] | None = None
    # Columns of the auctions that the form closes, and whether the highest bid wins.
    closes: tuple[list[str], bool] | None = None

    def keeps_sides(self, p: Params) -> bool:
        return self.sides is not None and self.bound(p) is None

    def keeps_open(self, p: Params) -> bool:
        return self.closes is not None and p.keep_open

    def plan(self, tables: Tables, p: Params) -> DataFrame:
        timed = tables if self.declares else with_watermarks(tables, p.watermark_delay)
        return self.build(timed, p)


def _interval(text):
    return F.expr(f"interval {text}")


def _timed(t, p, bound):
    """Event time is declared only where ``bound`` lets Spark drop state: it also drops late rows."""
    return t if bound is None else with_watermarks(t, p.watermark_delay)


def _near(left, right, horizon):
    if horizon is None:
        return F.lit(True)
    return (left >= right - _interval(horizon)) & (left <= right + _interval(horizon))


def _joined(many, many_key, one, one_key, condition, hot, salts):
    """Join with the matches of a hot key spread over ``salts`` state partitions.

    Streams are not re-planned at run time, so the split is made up front: a row of the larger side goes
    to one part, and rows of a hot key of the smaller side are copied to all of them.
    """
    many = many.withColumn("_part", part_of(many_key, hot, salts, *many.columns))
    one = one.withColumn("_copy", F.explode(parts_of(one_key, hot, salts)))
    equal = (F.col(many_key) == F.col(one_key)) & (F.col("_part") == F.col("_copy"))
    return many.join(one, equal & condition).drop("_part", "_copy")


def _paired(many, many_key, one, one_key, condition, hot, p):
    """Join of two sides. Kept ones are joined as batches, which adaptive execution splits by itself, so there
    only keys known to be hot are salted."""
    if not many.isStreaming and not hot:
        return many.join(one, (F.col(many_key) == F.col(one_key)) & condition)
    return _joined(many, many_key, one, one_key, condition, hot, p.join_salts)


def _join(sides, pairs, bound, **parts):
    return Form(
        lambda t, p: pairs(*sides(t, p), p), declares=True, sides=sides, pairs=pairs, bound=bound, **parts)


def _q3_sides(t, p):
    t = _timed(t, p, p.join_horizon)
    sellers = t.person.where(F.col("state").isin(*p.states)).select(
        F.col("id").alias("person_id"), "name", "city", "state",
        F.col("date_time").alias("registered"),
    )
    auctions = t.auction.where(F.col("category") == p.category).select("id", "seller", "date_time")
    return auctions, sellers


def _q3_pairs(auctions, sellers, p):
    near = _near(F.col("date_time"), F.col("registered"), p.join_horizon)
    found = _paired(auctions, "seller", sellers, "person_id", near, p.hot_sellers, p)
    return found.select("name", "city", "state", "id")


def _q20_sides(t, p):
    t = _timed(t, p, p.join_horizon)
    auction = t.auction.where(F.col("category") == p.category).select(
        "id", "item_name", "description", "initial_bid", "reserve",
        F.col("date_time").alias("auction_date_time"), "expires", "seller", "category",
        F.col("extra").alias("auction_extra"),
    )
    bid = t.bid.select(
        "auction", "bidder", "price", "channel", "url",
        F.col("ts").alias("bid_date_time"), F.col("extra").alias("bid_extra"),
    )
    return bid, auction


def _q20_pairs(bid, auction, p):
    near = _near(F.col("bid_date_time"), F.col("auction_date_time"), p.join_horizon)
    return _paired(bid, "auction", auction, "id", near, p.hot_auctions, p).drop("id")


def _matched(columns, **parts):
    """Bids while their auction is open.

    A given ``max_auction_length`` lets Spark drop old auctions. An auction open for longer then
    fails the query: its later bids would be lost.
    """

    def sides(t, p):
        t = _timed(t, p, p.max_auction_length)
        auction = t.auction.select(*columns)
        if p.max_auction_length is not None:
            last = F.col("date_time") + _interval(p.max_auction_length)
            too_long = F.raise_error(F.lit(f"an auction is open for more than {p.max_auction_length}"))
            auction = auction.withColumn(
                "expires", F.when(F.col("expires") > last, too_long).otherwise(F.col("expires"))
            )
        return t.bid.select("auction", "bidder", "price", "ts"), auction

    def pairs(bid, auction, p):
        while_open = F.col("ts").between(F.col("date_time"), F.col("expires"))
        if p.max_auction_length is not None:
            while_open &= F.col("ts") <= F.col("date_time") + _interval(p.max_auction_length)
        return _paired(bid, "auction", auction, "id", while_open, p.hot_auctions, p)

    return _join(sides, pairs, lambda p: p.max_auction_length, **parts)


def _finals(price):
    def highest(rows, p):
        return rows.groupBy("id", "category").agg(F.max(price).alias("final"))

    return highest


def _winners(columns, highest, answer):
    """The best bid so far of each auction per micro-batch; the best of those is the winner."""

    def best(rows, p):
        return best_match(rows, columns, ["id"], highest)

    def merge(stored, p):
        return best(stored.withColumnRenamed("bid_date_time", "ts"), p)

    return _matched(columns, batch=best, merge=merge, view=lambda stored, p: answer(merge(stored, p), p))


def _closing(columns, highest, answer):
    """Winners from state, or with ``keep_open`` a store, that ends with the auction (see ``closing``); the parts
    of an auction are merged when the answer is read."""

    def build(t, p):
        return winners(t.bid, t.auction, columns, highest, p.watermark_delay, p.hot_auctions, p.join_salts)

    def merge(stored, p):
        return best_match(stored.withColumnRenamed("bid_date_time", "ts"), columns, ["id"], highest)

    return Form(
        build, merge=merge, declares=True, view=lambda stored, p: answer(merge(stored, p), p), closes=(columns, highest))


def _finals_of(closed, p):
    return average_final(closed.select("category", F.col("price").alias("final")))


def _sellers_of(closed, p):
    return seller_average(closed.select("id", "seller", "price", "bid_date_time"), p)


def _q6(highest):
    def average(closed, p):
        return seller_average(closed.select("id", "seller", "price", "bid_date_time"), p)

    return _winners(["id", "seller", "date_time", "expires"], highest, average)


_Q6_COLUMNS = ["id", "seller", "date_time", "expires"]
_Q9_COLUMNS = [
    "id", "item_name", "description", "initial_bid", "reserve", "date_time", "expires", "seller",
    "category",
]


def _q5_view(stored, p):
    return busiest(window_counts(stored, "auction", p.hop_slide), p.broadcast_rows).select("auction", "num")


def _q7_view(stored, p):
    return highest_bids(stored).select("auction", "price", "bidder", F.col("ts").alias("date_time"))


def _repeated(rows, count, run=10_000):
    """Each row ``count`` times. In two steps, so that no array grows with a large count."""
    runs = F.explode(F.expr(f"sequence(0L, ({count} - 1) div {run})")).alias("_run")
    length = F.least(F.lit(run), F.col(count) - F.col("_run") * run)
    return rows.select("*", runs).select("*", F.explode(F.sequence(F.lit(1), length)).alias("_copy"))


def _q11_view(stored, p):
    return joined_slices(merged_slices(stored, "bidder"), "bidder", p.session_gap, "bid_count")


def _q12(t, p):
    """The time of the micro-batch is the event time, so that windows gone by leave the state."""
    clocked = t.bid.select("bidder", F.current_timestamp().alias("p_time"))
    return CATALOG["q12"](Tables(clocked.withWatermark("p_time", p.watermark_delay)), p, "p_time")


def _report(report, columns):
    return Form(
        build=lambda t, p: t.bid.select(*columns),
        batch=report.partial,
        merge=lambda stored, p: report.merge(stored),
        view=lambda stored, p: report.finish(report.merge(stored)),
    )


_BID_COLUMNS = ["ts", "auction", "bidder", "price", "channel", "url", "extra"]


def _q18_view(stored, p):
    return last_bids(stored).select(
        "auction", "bidder", "price", "channel", "url", F.col("ts").alias("date_time")
    )


_STATELESS = (
    "q0", "q0_r", "q1", "q1_r", "q1_r_both", "q2", "q2_r", "q10", "q13", "q14", "q14_r",
    "q21", "q21_r", "q21_r_anywhere", "q22", "q22_r",
)

FORMS: dict[str, Form] = {
    **{name: Form(CATALOG[name]) for name in _STATELESS},
    "q3": _join(_q3_sides, _q3_pairs, lambda p: p.join_horizon),
    "q4": _matched(
        ["id", "category", "date_time", "expires"], batch=_finals("price"), merge=_finals("final"),
        view=lambda stored, p: average_final(_finals("final")(stored, p)),
    ),
    "q5": Form(
        lambda t, p: t.bid.select("auction", "ts"), declares=True,
        batch=lambda rows, p: hop_panes(rows, "auction", "ts", p.hop_size, p.hop_slide),
        merge=lambda stored, p: merged_panes(stored, "auction"),
        view=_q5_view,
    ),
    "q6": _q6(highest=False),
    "q6_winning": _q6(highest=True),
    "q7": Form(
        lambda t, p: t.bid.select("auction", "price", "bidder", "ts"), declares=True,
        batch=lambda rows, p: highest_so_far(placed_bids(rows, p)),
        merge=lambda stored, p: highest_so_far(stored),
        view=_q7_view,
    ),
    "q8": Form(CATALOG["q8"]),
    "q9": _winners(_Q9_COLUMNS, True, lambda closed, p: closed),
    "q4_closing": _closing(["id", "category", "date_time", "expires"], True, _finals_of),
    "q6_closing": _closing(_Q6_COLUMNS, False, _sellers_of),
    "q6_winning_closing": _closing(_Q6_COLUMNS, True, _sellers_of),
    "q9_closing": _closing(_Q9_COLUMNS, True, lambda closed, p: closed),
    "q11": Form(
        lambda t, p: t.bid.select("bidder", "ts"), declares=True,
        batch=lambda rows, p: session_slices(rows, "bidder", "ts", p.session_gap),
        merge=lambda stored, p: merged_slices(stored, "bidder"),
        view=_q11_view,
    ),
    "q12": Form(
        _q12, mode="update", declares=True,
        merge=lambda stored, p: _newest_counts(stored),
        view=lambda stored, p: _newest_counts(stored),
    ),
    "q15": _report(R.DAY_REPORT, ["ts", "price", "bidder", "auction"]),
    "q16": _report(R.CHANNEL_DAY_REPORT, ["ts", "channel", "price", "bidder", "auction"]),
    "q16_r": _report(R.CHANNEL_REPORT, ["channel", "price", "bidder", "auction"]),
    "q17": _report(R.AUCTION_DAY_REPORT, ["ts", "auction", "price"]),
    "q17_r": _report(R.AUCTION_REPORT, ["auction", "bidder", "price"]),
    "q18": Form(
        lambda t, p: t.bid.select(*_BID_COLUMNS),
        batch=lambda rows, p: last_bids(rows),
        merge=lambda stored, p: last_bids(stored),
        view=_q18_view,
    ),
    "q19": Form(
        lambda t, p: t.bid.select(*_BID_COLUMNS),
        batch=lambda rows, p: top_bids(rows, p).drop("rank_number"),
        merge=lambda stored, p: top_bids(stored, p).drop("rank_number"),
        view=lambda stored, p: top_bids(stored, p).withColumnRenamed("ts", "date_time"),
    ),
    "q20": _join(_q20_sides, _q20_pairs, lambda p: p.join_horizon),
}


def _newest_counts(stored):
    # Counts only grow, so the largest one of a window is the newest.
    return stored.groupBy("bidder", "window_start", "window_end").agg(
        F.max("bid_count").alias("bid_count")
    )
