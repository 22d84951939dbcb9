from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstream.functions import micros_of, slice_of


def sessions(rows: DataFrame, key: str, time: str, gap: str, count: str) -> DataFrame:
    """Sessions per ``key``: runs of events at most ``gap`` apart; the end is last event + gap.

    Events in one ``gap``-wide slice always share a session, so they are first reduced to
    (first, last, count) per slice with a partial aggregate. The ordered pass then sees at most
    time span / gap rows for a key, no matter how many events a hot key has.
    """
    return joined_slices(session_slices(rows, key, time, gap), key, gap, count)


def session_slices(rows: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    micros = F.unix_micros(time)
    return (
        rows.where(F.col(time).isNotNull())
        .groupBy(key, slice_of(time, gap).alias("_slice"))
        .agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("_n"))
    )


def merged_slices(slices: DataFrame, key: str) -> DataFrame:
    """One row per key and slice from those of several sets of events."""
    return slices.groupBy(key, "_slice").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"))


def joined_slices(slices: DataFrame, key: str, gap: str, count: str) -> DataFrame:
    width = micros_of(gap)
    in_order = Window.partitionBy(key).orderBy("_slice")
    opens = F.col("_first") - F.lag("_last").over(in_order) > width
    started = slices.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("long"))
    session = F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        started.withColumn("_session", session)
        .groupBy(key, "_session")
        .agg(F.min("_first").alias("_start"), F.max("_last").alias("_end"), F.sum("_n").alias(count))
        .select(
            key,
            count,
            F.timestamp_micros("_start").alias("session_start"),
            F.timestamp_micros(F.col("_end") + width).alias("session_end"),
        )
    )
