"""Sinks for batch frames and for streams."""

from bidstream.sinks.batch import (
    as_json_lines,
    discard,
    to_kafka,
    write_files,
    write_hash_partitioned,
    write_keyed_lines,
)
from bidstream.sinks.stream import (
    discard_stream,
    file_stream,
    kafka_stream,
    snapshot_stream,
    upsert_stream,
)

__all__ = [
    "as_json_lines", "discard", "to_kafka", "write_files", "write_hash_partitioned",
    "write_keyed_lines", "discard_stream", "file_stream", "kafka_stream",
    "snapshot_stream", "upsert_stream",
]
