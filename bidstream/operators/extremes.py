from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstream.workspace import frozen


def rows_at_max(rows: DataFrame, group: str, value: str, among=None, few: int = 0) -> DataFrame:
    """Rows whose ``value`` equals the largest in their ``group``; ties are all kept.

    ``among`` limits which rows define the maximum. Three steps, none of which gathers a group:

    1. the maximum per group, by partial and final aggregation;
    2. each task drops the rows below its own maximum of the group (rank within the task, so the
       limit applies before any shuffle and a group of the window is at most one task's rows);
    3. the few rows left are joined with the maximum on (group, value).

    The second step sorts the rows of each task. With ``few``, the maxima are stored first, and if there are no more
    groups than that, they are shipped to the tasks in its place: nothing but the maxima is sorted or moved.
    """
    defining = rows if among is None else rows.where(among)
    best = defining.groupBy(F.col(group).alias("_group")).agg(F.max(value).alias("_best"))
    if few:
        best = frozen(best)
        if best.count() <= few:
            at_best = (rows[group] == best["_group"]) & (rows[value] == best["_best"])
            return rows.join(F.broadcast(best), at_best).drop("_group", "_best")

    # Rows that do not define the maximum must not displace those that do.
    parts = [group, "_task"] if among is None else [group, "_task", "_defining"]
    placed = rows.withColumn("_task", F.spark_partition_id())
    if among is not None:
        placed = placed.withColumn("_defining", among)
    local = Window.partitionBy(*parts).orderBy(F.desc(value))
    candidates = placed.withColumn("_rank", F.rank().over(local)).where(F.col("_rank") <= 1)
    return candidates.join(
        best,
        (candidates[group] == best["_group"]) & (candidates[value] == best["_best"]),
    ).drop("_task", "_defining", "_rank", "_group", "_best")
