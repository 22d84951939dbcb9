import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bidstream.schemas import AUCTION, BID, PERSON  # noqa: E402
from bidstream.sources.tables import Tables  # noqa: E402
from bidstream.streaming import configure_streaming  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure_streaming(session)
    yield session
    session.stop()


def at(text):
    """A UTC time on 2024-01-01 from 'HH:MM:SS', or from a full ISO text."""
    full = text if "-" in text else f"2024-01-01T{text}"
    return datetime.fromisoformat(full).replace(tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def make(spark):
    """Small tables from partial rows; columns not given are NULL."""

    def rows(schema, given):
        full = [tuple(g.get(f.name) for f in schema.fields) for g in given]
        return spark.createDataFrame(full, schema)

    def tables(bid=(), auction=(), person=()):
        return Tables(rows(BID, bid), rows(AUCTION, auction), rows(PERSON, person))

    return tables


def values(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())
