"""Session settings the queries rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Day, hour and minute columns are defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys: split the hot partition, and do so even when the aggregate above then
    # needs a shuffle of its own (it is fed by partial aggregates, so that shuffle is small).
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

_TARGET_PARTITION_BYTES = 64 << 20  # of stored, compressed input


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply ``SETTINGS``; with ``input_bytes`` also size the shuffles for that input.

    Adaptive execution merges shuffle partitions that turn out small but never adds any, so a
    large input has to start from enough of them.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        spark.conf.set(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
            str(shuffle_partitions(input_bytes, spark.sparkContext.defaultParallelism)),
        )
    return spark


def shuffle_partitions(input_bytes: int, cores: int) -> int:
    wanted = -(-input_bytes // _TARGET_PARTITION_BYTES)
    return max(wanted, cores)
