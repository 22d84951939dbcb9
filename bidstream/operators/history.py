from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstream.operators.ordering import numbered


def trailing_average(
    rows: DataFrame, key: str, order, value: str, preceding: int, block: int, name: str
) -> DataFrame:
    """Average of ``value`` over the current and ``preceding`` earlier rows of the same ``key``.

    A plain window would sort a key's whole history in one task. Here all rows get a dense number
    in (key, order), so each key is a contiguous run; the numbers are cut into blocks of ``block``
    rows, each carrying a copy of the ``preceding`` rows before it, and the frame runs inside the
    blocks. However long one history is, no task sees more than its blocks.
    """
    placed = numbered(rows.select(key, *order, value), [key, *order], "_index")
    own = F.expr(f"_index div {block}")
    last = F.expr(f"(_index + {preceding}) div {block}")
    copies = placed.select(
        key, value, "_index", own.alias("_own"), F.explode(F.sequence(own, last)).alias("_block")
    )
    frame = Window.partitionBy("_block", key).orderBy("_index").rowsBetween(-preceding, 0)
    return (
        copies.withColumn(name, F.avg(value).over(frame))
        .where(F.col("_block") == F.col("_own"))
        .select(key, name)
    )
