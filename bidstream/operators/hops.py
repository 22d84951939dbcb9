"""Counts per key and sliding window, from mergeable counts per pane: a run of times that the same windows hold."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstream.functions.times import hop_ends, micros_of


def hop_panes(rows: DataFrame, key: str, time: str, size: str, slide: str) -> DataFrame:
    """Rows per key and pane, with the starts of the oldest and the newest window of the pane."""
    oldest, newest = hop_ends(time, size, slide)
    return (
        rows.where(F.col(time).isNotNull())
        .groupBy(key, oldest.alias("_oldest"), newest.alias("_newest"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_oldest <= _newest")
    )


def merged_panes(panes: DataFrame, key: str) -> DataFrame:
    """One row per key and pane from those of several sets of rows."""
    return panes.groupBy(key, "_oldest", "_newest").agg(F.sum("_n").alias("_n"))


def window_counts(panes: DataFrame, key: str, slide: str) -> DataFrame:
    """``key``, ``starttime`` in epoch microseconds and ``num`` of every window that holds rows of the key.

    A pane raises the count of its key at its oldest window and lowers it behind its newest. So the counts are
    running sums over two rows per pane, in order of the windows: panes are moved and sorted, not a row per
    window, and no count is looked up. The ordered pass sees at most two rows per pane of a key and set of
    rows, no matter how many rows a hot key has.
    """
    step = F.lit(micros_of(slide))
    edges = panes.repartition(key).select(key, F.explode(F.array(
        F.struct(F.col("_oldest").alias("at"), F.col("_n").alias("change")),
        F.struct((F.col("_newest") + step).alias("at"), (-F.col("_n")).alias("change")),
    )).alias("_edge")).select(key, "_edge.*")
    in_order = Window.partitionBy(key).orderBy("at")
    # Of edges at one window, whose sums are equal, only the last has a later one behind it.
    levels = edges.select(
        key, "at", F.sum("change").over(in_order).alias("num"), F.lead("at").over(in_order).alias("_until"))
    held = levels.where("num > 0 AND at < _until")
    return held.select(key, F.explode(F.sequence("at", F.col("_until") - step, step)).alias("starttime"), "num")
