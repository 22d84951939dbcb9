"""Replay metrics: one row per query, and the report files made of them."""

import json
import time
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

METRICS = StructType(
    [
        StructField("query", StringType()),
        StructField("state", StringType()),
        StructField("input_rows", LongType()),
        StructField("expected_rows", LongType()),
        StructField("inserted_rows", LongType()),
        StructField("batches", LongType()),
        StructField("state_rows", LongType()),
        StructField("replay_sec", DoubleType()),
        StructField("throughput_rps", DoubleType()),
    ]
)


class Tally:
    """Rows and batches of a query, summed as it runs: they hold beyond what Spark retains."""

    def __init__(self, query):
        self.query, self.rows, self.batches, self.state_rows, self._last = query, 0, 0, 0, -1

    def update(self):
        for p in self.query.recentProgress:
            # Idle triggers report too, under the number of the batch to come.
            if p["batchId"] > self._last and "addBatch" in p["durationMs"]:
                self._last = p["batchId"]
                self.rows += p["numInputRows"]
                self.batches += 1
                self.state_rows = sum(o["numRowsTotal"] for o in p["stateOperators"])
        return self


def measure(name, query, seconds, expected=None, inserted=None, tally=None) -> dict:
    """Figures of a finished query, from its own progress records."""
    tally = (tally or Tally(query)).update()
    return {
        "query": name,
        "state": outcome(query, expected, inserted),
        "input_rows": tally.rows,
        "expected_rows": expected,
        "inserted_rows": inserted,
        "batches": tally.batches,
        "state_rows": tally.state_rows,
        "replay_sec": seconds,
        "throughput_rps": tally.rows / seconds if seconds > 0 else None,
    }


def run_and_measure(name, begin, stall=None, expected=None, inserted=lambda: None) -> dict:
    """Run ``begin()`` until its query ends by itself.

    With ``stall``, a query is stopped after so many seconds without progress, however long it has
    run; neither a finished batch nor a finished task is no progress.
    """
    started = time.monotonic()
    query = begin()
    tally = Tally(query)
    try:
        ended = _ended(query, tally, stall)
    except StreamingQueryException:
        return measure(name, query, time.monotonic() - started, expected, tally=tally)
    seconds = time.monotonic() - started
    if not ended:
        query.stop()
        return measure(name, query, seconds, expected, tally=tally) | {"state": "timeout"}
    return measure(name, query, seconds, expected, inserted(), tally)


def _ended(query, tally, stall) -> bool:
    tracker = SparkSession.getActiveSession().sparkContext.statusTracker()
    seen, since = None, time.monotonic()
    while not query.awaitTermination(1):
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        now = tally.update().batches, sorted((s.stageId, s.numCompletedTasks) for s in stages if s)
        if now != seen:
            seen, since = now, time.monotonic()
        elif stall is not None and time.monotonic() - since > stall:
            return False
    return True


def outcome(query, expected, inserted) -> str:
    """'failed', 'running', 'short' (rows missing or in excess) or 'finished'."""
    if query.exception() is not None:
        return "failed"
    if query.isActive:
        return "running"
    if None not in (expected, inserted) and expected != inserted:
        return "short"
    return "finished"


def metrics_frame(spark: SparkSession, measured: list[dict]) -> DataFrame:
    names = METRICS.fieldNames()
    return spark.createDataFrame([tuple(m[n] for n in names) for m in measured], METRICS)


def report(engine, mode, fixture, fixture_metadata, dataset_stats, sink_mode, measured) -> dict:
    return {
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "engine": engine,
        "mode": mode,
        "fixture": fixture,
        "fixture_metadata": fixture_metadata,
        "dataset_stats": dataset_stats,
        "sink_mode": sink_mode,
        "results": measured,
    }


def markdown(content: dict) -> str:
    """The report as a table; figures that were not taken show as '-'."""

    def cell(value):
        if value is None:
            return "-"
        return f"{value:.3f}" if isinstance(value, float) else str(value)

    names = METRICS.fieldNames()
    lines = [
        f"# Replay report ({content['engine']}, {content['mode']}, sink: {content['sink_mode']})",
        "",
        f"Generated at {content['generated_at']} over {content['fixture']}.",
        "",
        "| " + " | ".join(names) + " |",
        "|" + " --- |" * len(names),
    ]
    lines += ["| " + " | ".join(cell(m.get(n)) for n in names) + " |" for m in content["results"]]
    return "\n".join(lines) + "\n"


def save_report(spark: SparkSession, content: dict, folder: str) -> None:
    """report.json and report.md as one-line-per-row text datasets under ``folder``."""
    for name, text in (
        ("report.json", json.dumps(content, default=str)),
        ("report.md", markdown(content)),
    ):
        lines = spark.createDataFrame([(line,) for line in text.splitlines()], "value string")
        lines.coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
