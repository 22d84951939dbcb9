"""Text and JSON sources: keyed lines, decoding, and the combined person/auction/bid stream."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from bidstream.schemas import AUCTION_TYPE, BID, BID_TYPE, COMBINED_EVENT, PERSON_TYPE
from bidstream.sources.tables import Tables

_CORRUPT = "_corrupt"


class Decoded(NamedTuple):
    rows: DataFrame
    quarantine: DataFrame  # (key, payload) of lines that are not valid records


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def split_key(lines: DataFrame) -> DataFrame:
    """(key, payload) of ``key<TAB>json`` or plain ``json`` lines; blank lines are skipped."""
    line = F.trim("value", F.lit(" \t\r"))
    tab = F.instr(line, "\t")
    return lines.where(F.length(line) > 0).select(
        F.when(tab > 0, F.substr(line, F.lit(1), tab - 1)).alias("key"),
        F.when(tab > 0, F.substr(line, tab + 1)).otherwise(line).alias("payload"),
    )


def decode(records: DataFrame, schema: StructType = BID) -> DataFrame:
    """Strict decoding of ``payload``: a malformed record fails the query."""
    parsed = F.from_json("payload", schema, {"mode": "FAILFAST"})
    return records.select("key", parsed.alias("_record")).select("key", "_record.*")


def decode_lenient(records: DataFrame, schema: StructType = BID) -> Decoded:
    """Lenient decoding: malformed records go to a quarantine frame instead."""
    widened = StructType(schema.fields + [StructField(_CORRUPT, StringType(), True)])
    parsed = F.from_json(
        "payload", widened, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    decoded = records.select("key", "payload", parsed.alias("_record"))
    broken = F.col("_record").isNull() | F.col(f"_record.{_CORRUPT}").isNotNull()
    return Decoded(
        rows=decoded.where(~broken).select("key", "_record.*").drop(_CORRUPT),
        quarantine=decoded.where(broken).select("key", "payload"),
    )


def read_bids(spark: SparkSession, path: str) -> DataFrame:
    return decode(split_key(read_lines(spark, path)))


def stream_bids(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return decode(split_key(stream_lines(spark, path, files_per_trigger)))


def record_count(spark: SparkSession, path: str) -> int:
    """Records in a log of lines, e.g. to see whether it is fully loaded."""
    return split_key(read_lines(spark, path)).count()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Combined events from JSON lines, keyed or not."""
    return decode(split_key(read_lines(spark, path)), COMBINED_EVENT).drop("key")


def demultiplex(events: DataFrame) -> Tables:
    """The flat tables inside a combined stream, one per event type."""

    def part(kind, record, time):
        rows = events.where(F.col("event_type") == kind).select(f"{record}.*")
        return rows.withColumnRenamed("dateTime", time)

    return Tables(
        bid=part(BID_TYPE, "bid", "ts").select(*BID.fieldNames()),
        auction=part(AUCTION_TYPE, "auction", "date_time"),
        person=part(PERSON_TYPE, "person", "date_time"),
    )


def multiplex(t: Tables) -> DataFrame:
    """The combined stream holding all rows of the flat tables."""

    def tagged(rows, kind, record, time):
        fields = COMBINED_EVENT[record].dataType.fieldNames()
        packed = F.struct(*[F.col(time if f == "dateTime" else f).alias(f) for f in fields])
        return rows.select(F.lit(kind).alias("event_type"), packed.alias(record))

    return (
        tagged(t.person, PERSON_TYPE, "person", "date_time")
        .unionByName(tagged(t.auction, AUCTION_TYPE, "auction", "date_time"), allowMissingColumns=True)
        .unionByName(tagged(t.bid, BID_TYPE, "bid", "ts"), allowMissingColumns=True)
    )


def with_watermarks(t: Tables, delay: str) -> Tables:
    """Declare event time on every table that is present; zoneless times get the session zone."""

    def declared(rows, column):
        if rows is None:
            return None
        if isinstance(rows.schema[column].dataType, TimestampNTZType):
            rows = rows.withColumn(column, F.col(column).cast("timestamp"))
        return rows.withWatermark(column, delay)

    return Tables(
        declared(t.bid, "ts"), declared(t.auction, "date_time"), declared(t.person, "date_time")
    )
