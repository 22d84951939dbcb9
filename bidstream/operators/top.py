from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_rows(rows: DataFrame, by, order, k: int, rank: str = "rank_number") -> DataFrame:
    """First ``k`` rows per ``by`` in ``order``, with their position.

    Spark limits each group to ``k`` rows before the shuffle (WindowGroupLimit), so a hot group
    arrives as at most ``k`` rows per upstream task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
