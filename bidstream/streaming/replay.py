"""Replay of finite tables as streams: staging in time slices, running, and measuring."""

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from bidstream import workspace
from bidstream.params import Params
from bidstream.schemas import AUCTION, BID, PERSON
from bidstream.sources.tables import Tables
from bidstream.streaming.forms import FORMS
from bidstream.streaming.run import result, start

_TIME = {"bid": "ts", "auction": "date_time", "person": "date_time"}
_SCHEMA = {"bid": BID, "auction": AUCTION, "person": PERSON}
# Closing rows lie years after all data, so their event time tells them apart, and carry ids that
# match nothing.
_YEAR = 365 * 86_400_000_000
_CLOSING_IDS = {"bid": {"auction": -2, "bidder": -2, "price": 0}, "auction": {"id": -1, "seller": -3},
                "person": {"id": -4}}

# Forms that finish by event time, with the column of their stored rows that holds it; none where closing
# rows leave no stored rows, as their auctions have no bids.
CLOSING = {"q8": "starttime",
           "q4_closing": None, "q6_closing": None, "q6_winning_closing": None, "q9_closing": None}


class Stage(NamedTuple):
    path: str
    files: int  # files per slice: one slice is one micro-batch
    end: int  # microseconds; all data lie before, all closing rows after

    def data(self, column: str):
        return F.col(column) < F.timestamp_micros(F.lit(self.end))

    def tables(self, spark: SparkSession, closing: bool) -> Tables:
        return Tables(**{name: self._stream(spark, name, closing) for name in _TIME})

    def _stream(self, spark, name, closing):
        part = "*" if closing else "data-*"
        return (
            spark.readStream.schema(_SCHEMA[name]).option("maxFilesPerTrigger", self.files)
            .parquet(f"{self.path}/{name}/{part}")
        )


def stage(t: Tables, path: str, slices: int, files: int) -> Stage:
    """Write the tables as ``slices`` consecutive time slices plus two closing slices.

    A file stream takes files in the order they were written, so the slices are written one after
    the other; the rows of a slice are written in parallel. Two closing slices are needed because
    a watermark advances only for the micro-batch after the one that saw the time.

    Rows are dealt to files by the hash of all their columns. Dealing them in turn would have every task sort
    all its rows first, so that a retried one deals them alike, and that sort spills once tasks are large.
    A file that got no rows is added empty: with fewer files a micro-batch would reach into the next slice.
    """
    spark = t.bid.sparkSession
    tables = {name: getattr(t, name) for name in _TIME if getattr(t, name) is not None}
    spans = [
        rows.agg(F.min(F.unix_micros(_TIME[name])), F.max(F.unix_micros(_TIME[name]))).first()
        for name, rows in tables.items()
    ]
    low = min((s[0] for s in spans if s[0] is not None), default=0)
    high = max((s[1] for s in spans if s[1] is not None), default=0)
    # Auctions may stay open beyond all data; the closing rows come after them too.
    last = tables["auction"].agg(F.max(F.unix_micros("expires"))).first()[0] if "auction" in tables else None
    cuts = [low + (high - low) * n // slices for n in range(slices)] + [high + 1]
    for number, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        for name, rows in tables.items():
            at = F.unix_micros(_TIME[name])
            mine = (at >= begin) & (at < end)
            mine = mine | at.isNull() if number == 0 else mine
            part = rows.where(mine).select(*_SCHEMA[name].fieldNames())
            _write(dealt(part, files), folder := f"{path}/{name}/data-{number}")
            for _ in range(files - sum(file.endswith(".parquet") for file in workspace.names(spark, folder))):
                spark.createDataFrame([], part.schema).coalesce(1).write.mode("append").parquet(folder)
    end = max(high, last or 0) + _YEAR
    for number in range(2):
        for name in tables:
            moment = end + (1 + number) * _YEAR
            _write(_closing(spark, name, number, moment, files), f"{path}/{name}/end-{number}")
    return Stage(path, files, end)


def dealt(rows: DataFrame, files: int) -> DataFrame:
    return rows.repartition(files, *rows.columns)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def _closing(spark, name, number, moment, files):
    # The auctions of the two slices differ.
    fixed = {field: value - 100 * number if field == "id" else value for field, value in _CLOSING_IDS[name].items()}

    def value(field):
        # Every time column is set: Spark may drop rows with a NULL one ahead of the watermark.
        if isinstance(field.dataType, TimestampType):
            return F.timestamp_micros(F.lit(moment))
        return F.lit(fixed.get(field.name))

    one_per_file = spark.range(0, files, 1, files)
    return one_per_file.select(
        *[value(f).cast(f.dataType).alias(f.name) for f in _SCHEMA[name].fields]
    )


def replay(name: str, staged: Stage, spark: SparkSession, p: Params = Params(), fan: int = 8):
    """Run one form over a staged log until it is drained: (result frame, finished query, seconds)."""
    form = FORMS[name]
    tables = staged.tables(spark, closing=name in CLOSING)
    folder = workspace.fresh(spark, f"replay-{name}")
    began = time.monotonic()
    query = start(form, tables, f"{folder}/store", f"{folder}/checkpoint", p, fan=fan)
    query.awaitTermination()
    seconds = time.monotonic() - began
    keep = staged.data(CLOSING[name]) if CLOSING.get(name) else None
    answer = result(form, tables, spark, f"{folder}/store", p, keep=keep)
    return answer, query, seconds
