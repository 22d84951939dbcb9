"""Topic source: options, decoding and row count. Needs Spark's Kafka connector on the class path."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.schemas import BID
from bidstream.sources.events import decode


def source_options(
    brokers: str, topic: str, group: str | None = None, offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Replay of a topic from its first record."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if group:
        options["kafka.group.id"] = group
    if offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(offsets_per_trigger)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)  # split large topic partitions
    return options


def stream_bids(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return bids_of_records(spark.readStream.format("kafka").options(**options).load())


def read_bids(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return bids_of_records(spark.read.format("kafka").options(**options).load())


def bids_of_records(records: DataFrame) -> DataFrame:
    """Flat bids from records with binary ``key`` and JSON ``value``."""
    return decode(
        records.select(F.col("key").cast("string"), F.col("value").cast("string").alias("payload")),
        BID,
    )


def record_count(spark: SparkSession, options: dict[str, str]) -> int:
    """Records between the earliest and the latest offsets, e.g. to see whether a log is loaded."""
    bounded = {**options, "endingOffsets": "latest"}
    bounded.pop("maxOffsetsPerTrigger", None)
    return spark.read.format("kafka").options(**bounded).load().count()
