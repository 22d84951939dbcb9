from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstream.workspace import frozen, held


def numbered(rows: DataFrame, order, name: str = "row_index") -> DataFrame:
    """Dense global row numbers from 0 in ``order``, without a single-task sort.

    The rows are range-partitioned and sorted, then frozen to the checkpoint folder so that the
    partition layout is fixed even if executors are lost. A row's number is its place in its
    partition plus the sizes of the partitions before it; only those sizes (one row per
    partition) are ever gathered. Rows equal in every column of ``order`` and in ``rows`` are
    interchangeable, so the source position is used as the last tie-breaker.
    """
    layout = frozen(
        rows.withColumn("_source", F.monotonically_increasing_id())
        .repartitionByRange(_partitions(rows), *order, "_source")
        .sortWithinPartitions(*order, "_source")
        .withColumn("_place", F.monotonically_increasing_id())
        .drop("_source")
    )
    return _counted_through(layout, layout, F.shiftrightunsigned(F.col("_place"), 33), name)


@contextmanager
def numbered_once(rows: DataFrame, order, name: str = "row_index"):
    """As ``numbered``, for use inside the context and without storing the rows, if ``order`` names all columns.

    Rows are then placed by their values alone, so the files of one shuffle serve the counting of its
    partitions and the numbering, also where a part of them has to be made again. Equal rows share a partition.
    """
    if not set(rows.columns) <= set(order):
        yield numbered(rows, order, name)
        return
    with held(rows.repartitionByRange(_partitions(rows), *order)) as layout:
        placed = layout.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
        yield _counted_through(placed, layout, F.spark_partition_id(), name)


def _counted_through(placed: DataFrame, layout: DataFrame, part, name: str) -> DataFrame:
    """``placed`` with dense numbers: ``part`` is the partition of a row of ``layout``, which has the same rows in each."""
    sizes = layout.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_start"),
    )
    # The id is (partition << 33) + position in the partition. One row per partition: the broadcast is
    # bounded by the partition count.
    return (
        placed.withColumn("_part", F.shiftrightunsigned(F.col("_place"), 33))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_start", "_place")
    )


def take_first(rows: DataFrame, order, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``; fails if there are fewer."""
    kept = numbered(rows, order, "_index").where(F.col("_index") < n).drop("_index")
    found = kept.count()
    if found < n:
        raise ValueError(f"found {found} rows, need {n}")
    return kept


def _partitions(rows: DataFrame) -> int:
    conf = rows.sparkSession.conf
    initial = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or conf.get("spark.sql.shuffle.partitions"))
