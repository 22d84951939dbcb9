"""Winning bids of auctions that close: one session window per auction, which ends when it expires.

An auction is an event whose session lasts from ``date_time`` to ``expires``; a bid is an event that lasts for
a moment. Sessions of one id that overlap are one, so an auction's session holds the bids made while it was
open, and keeps the best of them and the auction's row. When the watermark passes its end no bid of it can come
any more: the winner goes out and the state goes. Bids ahead of their auction are sessions of their own, until
the auction joins them or the watermark passes them. So the state follows the auctions that are open,
without a constant bound on their length, and a micro-batch touches only sessions that it has rows of.

A hot auction (any, if ``hot`` is None) is copied to ``salts`` parts and its bids are spread over them, so
that it is no single task's; each part gives the best of its own bids, and the answer is the best of the parts.

Events whose session ended before the watermark are dropped by Spark. Auctions that end before they begin, or
without either time, and bids without a time, a price or an auction match nothing. An id is one auction at a
time: a different row of it that overlaps it in time fails the query, and a repeated one changes nothing.

``winners`` holds the sessions in Spark's own state, a key-value store that takes each of them by itself. ``settled``
holds them in a store of parts beside the checkpoint, and a micro-batch sorts and joins them as tables: the bids
with the auctions they fall in, then the sessions of each id. What it writes is all that it read and is still open,
and the winners that it closes. The rule for closing and for late events is that of Spark: a micro-batch closes what
ended before the latest time of the earlier ones, less the delay, and drops what that had closed already when
it was the micro-batch before.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidstream.operators.hot_keys import part_of, parts_of
from bidstream.sinks import store
from bidstream.sources.tables import Tables


def winners(bid: DataFrame, auction: DataFrame, columns: list[str], highest: bool, delay: str, hot: tuple | None, salts: int) -> DataFrame:
    """``columns`` of each closed auction that had a bid, with auction, bidder, price and bid_date_time of the
    best bid of each part. ``columns`` name id, date_time and expires."""
    carried = F.struct(*columns)
    bids = bid.where(_BIDS).select(
        F.col("auction").alias("_id"), part_of("auction", hot, salts, "bidder", "price", "ts").alias("_part"),
        F.unix_micros("ts").alias("_from"), F.unix_micros("ts").alias("_to"), _offer(highest).alias("bid"))
    rows = auction.where(_AUCTIONS).select(
        F.col("id").alias("_id"), F.explode(parts_of("id", hot, salts)).alias("_part"),
        F.unix_micros("date_time").alias("_from"), F.unix_micros("expires").alias("_to"), carried.alias("row"))
    # Both ends belong to an auction, but sessions that only touch are one too. So times count half
    # microseconds, and every session ends half a microsecond after its last moment.
    lasts = F.make_interval(secs=((F.col("_to") - F.col("_from")) * 2 + 1).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))
    events = (
        bids.unionByName(rows, allowMissingColumns=True)
        .select("_id", "_part", F.timestamp_micros(F.col("_from") * 2).alias("_at"), lasts.alias("_lasts"), "bid", "row")
        .withWatermark("_at", f"{delay} {delay}")
    )
    closed = events.groupBy("_id", "_part", F.session_window("_at", F.col("_lasts"))).agg(
        F.min("bid").alias("best"), F.min("row").alias("row"), F.max("row").alias("_other"))
    whole = F.when(_one_auction(), F.col("row").isNotNull() & F.col("best").isNotNull())
    return _won(closed.where(whole.otherwise(_different("boolean"))), "best", highest)


_BIDS = "price IS NOT NULL AND ts IS NOT NULL AND auction IS NOT NULL"
_AUCTIONS = "id IS NOT NULL AND date_time <= expires"


def _offer(highest):
    order = -F.col("price") if highest else F.col("price")
    return F.struct(order.alias("order"), "ts", "bidder")


def _one_auction():
    return F.col("row").eqNullSafe(F.col("_other"))


def _different(kind):
    return F.raise_error(F.concat(F.lit("two different auctions of id "), "_id")).cast(kind)


def _won(closed, best, highest):
    won = F.col(f"{best}.order")
    return closed.select(
        "row.*", F.col("row.id").alias("auction"), f"{best}.bidder", (-won if highest else won).alias("price"),
        F.col(f"{best}.ts").alias("bid_date_time"))


# --- open sessions in a store ----------------------------------------------------------------------

_VERSIONS = 1  # only what the newest micro-batch wrote is read again
_CLOCK = "late long, closed long, latest long"


def sides(t: Tables, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return t.bid.where(_BIDS).select("auction", "bidder", "price", "ts"), t.auction.where(_AUCTIONS).select(*columns)


def settled(
    spark: SparkSession, batch: DataFrame, batch_id: int, folder: str, owner: str,
    columns: list[str], highest: bool, delay: str, hot: tuple | None, salts: int,
) -> DataFrame:
    """The winners that micro-batch ``batch_id`` closes, after keeping its sessions under ``folder``.

    A micro-batch is kept once, with the winners it closes; so one that is retried finds the same winners. Its
    rows are stored first: read from there, they are planned by the session and not by the stream, for which
    nothing is planned anew while it runs.
    """
    store.add(batch, batch_id, f"{folder}/new", owner, replace=True, versions=_VERSIONS)
    batch = store.read(spark, f"{folder}/new", batch.schema)
    late, closed = _clock(spark, batch, batch_id, f"{folder}/clock", owner, delay)
    bids, rows = (batch.where(F.col(side).isNotNull()).select(f"{side}.*") for side in ("many", "one"))
    new = _sessions(bids, rows, columns, highest).where(~_ended("_to", late))
    kept = new.select("_id", "offer", "row", F.lit(False).alias("closed"))
    if store.current(spark, f"{folder}/open").last < batch_id:
        before = store.read(spark, f"{folder}/open", kept.schema).where("NOT closed")
        now = _met(new.unionByName(_timed(before)), hot, salts).withColumn("closed", _ended("_to", closed))
        now = now.where("NOT closed OR (row IS NOT NULL AND offer IS NOT NULL)").select(*kept.columns)
        store.add(now, batch_id, f"{folder}/open", owner, replace=True, versions=_VERSIONS)
    return _won(store.read(spark, f"{folder}/open", kept.schema).where("closed"), "offer", highest)


def _sessions(bids, rows, columns, highest):
    """Bids, as ``offer`` without ``row``, and auctions, as ``row`` without ``offer``, with their first and last moment."""
    offers = bids.select(F.col("auction").alias("_id"), _offer(highest).alias("offer"))
    carried = rows.select(F.col("id").alias("_id"), F.struct(*columns).alias("row"))
    return _timed(offers.unionByName(carried, allowMissingColumns=True))


def _timed(sessions):
    first, last = (F.coalesce(F.col(f"row.{end}"), F.col("offer.ts")) for end in ("date_time", "expires"))
    return sessions.select("_id", "offer", "row", F.unix_micros(first).alias("_from"), F.unix_micros(last).alias("_to"))


def _met(sessions, hot, salts):
    """Each auction with the best of the offers made while it was open, and the bids that are in no auction.

    The joins are those of a batch, which adaptive execution splits by itself, so only keys known to be hot are
    salted. After them an auction meets one offer, so that no task gathers the bids of a key.
    """
    bids = sessions.where("row IS NULL").select("_id", "offer", F.col("_from").alias("_at"))
    auctions = sessions.where("row IS NOT NULL")
    spans = auctions.select(F.col("_id").alias("_auction"), F.col("_from").alias("_begin"), F.col("_to").alias("_end"))
    inside = (F.col("_id") == F.col("_auction")) & F.col("_at").between(F.col("_begin"), F.col("_end"))
    if hot:
        bids = bids.withColumn("_part", part_of("_id", hot, salts, "offer"))
        spans = spans.withColumn("_copy", F.explode(parts_of("_auction", hot, salts)))
        inside &= F.col("_part") == F.col("_copy")
    best = bids.join(spans, inside).groupBy("_id", F.col("_begin").alias("_from")).agg(F.min("offer").alias("offer"))
    alone = bids.join(spans, inside, "left_anti").select("_id", "offer", F.col("_at").alias("_to"))
    one = (
        auctions.unionByName(best, allowMissingColumns=True).repartition("_id").groupBy("_id", "_from")
        .agg(F.min("offer").alias("offer"), F.min("row").alias("row"), F.max("row").alias("_other"), F.max("_to").alias("_to"))
    )
    earlier = Window.partitionBy("_id").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    single = _one_auction() & F.coalesce(F.col("_from") > F.max("_to").over(earlier), F.lit(True))
    kind = sessions.schema["row"].dataType
    one = one.withColumn("row", F.when(single, F.col("row")).otherwise(_different(kind)))
    return one.select("_id", "offer", "row", "_to").unionByName(alone, allowMissingColumns=True)


def _ended(last, mark):
    # As in ``winners``, a session ends half a microsecond after its last moment, and marks count half ones.
    return F.lit(False) if mark is None else F.col(last) * 2 + 1 <= F.lit(mark)


def _clock(spark, batch, batch_id, path, owner, delay):
    """Marks of a micro-batch, in half microseconds: what ended before is late, and what ended before is closed."""
    if store.current(spark, path).last < batch_id:
        before = store.read(spark, path, spark.createDataFrame([], _CLOCK).schema).first()
        late, closed = (before.closed, before.latest) if before else (None, None)
        moment = F.unix_micros(F.coalesce("many.ts", "one.date_time"))
        # Spark keeps a watermark in whole milliseconds.
        mark = F.floor(F.max(moment) * 2 / 1000) * 1000 - 2 * F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {delay}"))
        found = batch.agg(mark.cast("long").alias("mark")).first().mark
        latest = max((m for m in (closed, found) if m is not None), default=None)
        store.add(spark.createDataFrame([(late, closed, latest)], _CLOCK), batch_id, path, owner, replace=True, versions=_VERSIONS)
    row = store.read(spark, path, spark.createDataFrame([], _CLOCK).schema).first()
    return row.late, row.closed
