from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, side: DataFrame, condition, side_rows: int, limit: int) -> DataFrame:
    """Join with a bounded side table, broadcast only while its row count is within ``limit``.

    A larger side table is joined by shuffle; adaptive execution splits hot keys there.
    """
    return rows.join(F.broadcast(side) if side_rows <= limit else side, condition)
