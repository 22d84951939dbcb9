from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.functions import day_of
from bidstream.operators.ordering import numbered, numbered_once

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_BID_ORDER = ["ts", "auction", "bidder", "price", "channel", "url", "extra"]


def discard(rows: DataFrame) -> None:
    """Evaluate everything, keep nothing."""
    rows.write.format("noop").mode("overwrite").save()


def write_files(rows: DataFrame, path: str, by=("date", "time")) -> None:
    """Parquet directories per ``by``, filled by evenly sized tasks.

    The rebalance hint gathers the rows of one directory so that it gets few files, and lets
    adaptive execution split a directory that holds too much for one task.
    """
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_hash_partitioned(rows: DataFrame, path: str, time="ts", key="auction", buckets=4) -> None:
    """Time-series table: a directory per day and hash bucket of ``key``."""
    placed = rows.withColumn("day", day_of(time)).withColumn(
        "bucket", F.pmod(F.xxhash64(key), F.lit(buckets))
    )
    write_files(placed, path, by=("day", "bucket"))


def as_json_lines(rows: DataFrame):
    return F.to_json(F.struct(*rows.columns), _JSON)


def keyed(rows: DataFrame, partitions: int, order=_BID_ORDER) -> DataFrame:
    """(key, value): JSON records in ``order``, with keys p0, p1, … dealt round-robin."""
    return _keyed(numbered(rows, order, "_index"), rows, partitions)


def _keyed(in_order, rows, partitions):
    return in_order.select(
        F.concat(F.lit("p"), F.col("_index") % partitions).alias("key"),
        as_json_lines(rows).alias("value"),
    )


def write_keyed_lines(rows: DataFrame, path: str, partitions: int, order=_BID_ORDER, compression="none") -> None:
    """Text lines ``key<TAB>json``; the files follow ``order``."""
    with numbered_once(rows, order, "_index") as in_order:
        lines = _keyed(in_order, rows, partitions).select(F.concat_ws("\t", "key", "value").alias("value"))
        lines.write.mode("overwrite").option("compression", compression).text(path)


def to_kafka(rows: DataFrame, brokers: str, topic: str, partitions: int) -> None:
    """Load a topic with keyed JSON records. Needs the Kafka connector."""
    (
        keyed(rows, partitions).write.format("kafka")
        .options(**{"kafka.bootstrap.servers": brokers, "topic": topic})
        .save()
    )
