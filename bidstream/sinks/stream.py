"""Stream sinks. Each returns a configured writer or a started query."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bidstream import workspace
from bidstream.sinks import store
from bidstream.sinks.batch import as_json_lines


def _writer(rows: DataFrame, name: str, checkpoint: str, mode: str):
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.queryName(name) if name else writer


def discard_stream(rows, name, checkpoint, mode="append"):
    return _writer(rows, name, checkpoint, mode).format("noop")


def file_stream(rows, name, checkpoint, path, by=("date", "time")):
    """Exactly-once Parquet directories per ``by``."""
    return (
        _writer(rows, name, checkpoint, "append").format("parquet")
        .option("path", path).partitionBy(*by)
    )


def kafka_stream(rows, name, checkpoint, brokers, topic, mode="update"):
    """JSON records to a topic; in update mode every change is sent as a new record."""
    return (
        _writer(rows.select(as_json_lines(rows).alias("value")), name, checkpoint, mode)
        .format("kafka").options(**{"kafka.bootstrap.servers": brokers, "topic": topic})
    )


def changes_stream(rows, name, checkpoint, path, mode="update"):
    """Every change as an insert, one directory per micro-batch, so a retried batch replaces itself."""

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _writer(rows, name, checkpoint, mode).foreachBatch(store)


def stored_stream(rows, name, checkpoint, path, mode, merge=None, fan=8, replace=False):
    """Micro-batches into a store (see ``store``), each counted once; rows carry their ``batch_id``."""

    def add(batch, batch_id):
        numbered = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        owner = query_id(batch.sparkSession, checkpoint)
        store.add(numbered, batch_id, path, owner, merge, fan, replace)

    return _writer(rows, name, checkpoint, mode).foreachBatch(add)


def query_id(spark, checkpoint) -> str:
    """The id that a query keeps across restarts from its checkpoint."""
    return json.loads(workspace.read_text(spark, f"{checkpoint}/metadata"))["id"]


def snapshot_stream(rows, name, checkpoint, path):
    """Materialized view: the complete result, rewritten by each micro-batch and swapped in whole.

    For a result with a key, ``upsert_stream`` writes only the rows that changed.
    """
    return stored_stream(rows, name, checkpoint, path, "complete", replace=True)


def latest_snapshot(spark, path, schema) -> DataFrame:
    """The newest committed version; one being written is passed over."""
    return store.read(spark, path, schema)


def upsert_stream(rows, name, checkpoint, path, keys=None, fan=8):
    """Changed rows of an updating query; ``upserted`` reads the newest row per key.

    With ``keys``, rows that a newer one replaced go when levels are merged, so that the store follows the
    number of keys and not the age of the stream. Without, every change stays.
    """

    def merge(stored):
        return _newest(stored, keys, F.max("batch_id").alias("batch_id"))

    return stored_stream(rows, name, checkpoint, path, "update", merge if keys else None, fan)


def upserted(spark, path, schema, keys) -> DataFrame:
    return newest_per_key(store.read(spark, path, _numbered(schema)), keys)


def newest_per_key(stored: DataFrame, keys) -> DataFrame:
    return _newest(stored, keys)


def _newest(stored, keys, *more):
    values = [c for c in stored.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_newest")
    kept = stored.groupBy(*keys).agg(newest, *more)
    return kept.select(*keys, "_newest.*", *[c for c in kept.columns if c == "batch_id"])


def _numbered(schema):
    return StructType([*schema.fields, StructField("batch_id", LongType())])
