"""Joins of two streams whose rows may meet at any later time: both sides are kept in stores.

Without a bound on time no row ever leaves the state of such a join. Spark's own state takes every row by a
few reads and writes of a key-value store of its own. Here a micro-batch adds its rows to the store of their
side, as columns, and is joined like any two tables: its rows of the larger side with all of the smaller, and
the earlier rows of the larger with its rows of the smaller. So each pair comes out once, in the micro-batch
that completes it, as from Spark's stream join. Being a batch join, it is planned for the rows it finds:
adaptive execution splits hot keys, and a small micro-batch is broadcast, so that kept rows are read but not moved.

A kept row carries the number of its micro-batch, and a side takes a micro-batch once; so one that is retried,
whatever it had done before, finds the same rows and gives the same pairs. ``fan`` parts of a level become one
of the next, so the list of parts stays short however many micro-batches there are.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.sinks import store

_SIDES = ("many", "one")


def tagged(many: DataFrame, one: DataFrame) -> DataFrame:
    """Both sides as one stream, without state: a row is in the column of its side."""
    packed = [side.select(F.struct(*side.columns).alias(name)) for name, side in zip(_SIDES, (many, one))]
    return packed[0].unionByName(packed[1], allowMissingColumns=True)


def completed(
    spark: SparkSession, batch: DataFrame, batch_id: int, folder: str, owner: str,
    pairs: Callable[[DataFrame, DataFrame], DataFrame], fan: int = 8,
) -> DataFrame:
    """The pairs that micro-batch ``batch_id`` completes, after keeping its rows under ``folder``."""
    for side in _SIDES:
        rows = batch.where(F.col(side).isNotNull()).select(f"{side}.*", F.lit(batch_id).cast("long").alias("_batch"))
        store.add(rows, batch_id, f"{folder}/{side}", owner, lambda stored: stored, fan)

    def kept(side, among):
        schema = batch.select(f"{side}.*", F.lit(batch_id).cast("long").alias("_batch")).schema
        return store.read(spark, f"{folder}/{side}", schema).where(among).drop("_batch")

    at = F.col("_batch")
    found = pairs(kept("many", at == batch_id), kept("one", at <= batch_id))
    if batch_id == 0:
        return found
    return found.unionByName(pairs(kept("many", at < batch_id), kept("one", at == batch_id)))
