"""Bounded labelled samples for training classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidstream.llm.tables import smallest

ROWS = 3_000  # of each label


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = ROWS) -> DataFrame:
    """label and text of at most ``rows`` training documents of each label, chosen by hash of the id.

    ``train`` is a condition on labels.doc_id. Labels that are null or neither 0 nor 1 are ignored,
    and of an id labelled twice the larger label counts. The chosen ids number at most 2 * ``rows``; of an
    id with several rows the text of the smallest hash counts, and a null text is empty.
    """
    usable = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [tuple(r) for value in (0, 1) for r in smallest(usable.where(F.col("label") == value), order, rows)]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    # At most 2 * rows ids of 12 bytes.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # Tasks drop all but their first row of an id before the shuffle.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    return found.withColumn("place", first).where("place = 1").select("label", "text")
