"""Keyed logs: numbered without storing the rows beside the log, compressed if asked for, and deleted once laid out."""

import gzip
import json
from pathlib import Path

import __spark_entry__ as registry
from bidstream import sinks, workspace
from bidstream.operators import ordering
from bidstream.operators.ordering import numbered_once
from bidstream.sources.events import read_bids
from conftest import at, values
from pyspark.sql import functions as F


def test_numbers_are_dense_and_nothing_is_stored(spark, monkeypatch):
    monkeypatch.setattr(ordering, "frozen", lambda rows: 1 / 0)
    before = set(Path(workspace.root(spark)).iterdir())
    rows = spark.range(1000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("v"), (F.col("id") % 400).alias("w"))
    with numbered_once(rows, ["v", "w"]) as found:
        got = found.collect()
        assert found.groupBy().sum("row_index").first()[0] == 999 * 500
    assert [r.row_index for r in sorted(got, key=lambda r: (r.v is not None, r.v or 0, r.w, r.row_index))] == list(range(1000))
    assert sorted((r.v is not None, r.v or 0, r.w) for r in got) == sorted((r.v is not None, r.v or 0, r.w) for r in rows.collect())
    assert set(Path(workspace.root(spark)).iterdir()) == before


def test_rows_that_the_order_does_not_tell_apart_are_stored(spark, monkeypatch):
    stored, real = [], ordering.frozen
    monkeypatch.setattr(ordering, "frozen", lambda rows: stored.append(1) or real(rows))
    rows = spark.range(300).select((F.col("id") % 7).alias("v"), "id")
    with numbered_once(rows, ["v"]) as found:
        assert values(found, "row_index") == [(n,) for n in range(300)] and stored


def test_compressed_lines_follow_the_order(spark, make, tmp_path):
    bid = make([dict(ts=at(f"10:{n % 60:02d}:00") if n % 7 else None, auction=n % 9, bidder=1, price=n % 4, extra="e" * (n % 3)) for n in range(400)]).bid
    sinks.write_keyed_lines(bid, str(tmp_path / "log"), 3, compression="gzip")
    files = sorted((tmp_path / "log").glob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    lines = [line.split("\t") for f in files for line in gzip.open(f, "rt").read().splitlines()]
    assert [key for key, _ in lines] == [f"p{n % 3}" for n in range(400)]
    records = [json.loads(text) for _, text in lines]
    order = [(r["ts"] or "", r["auction"], r["bidder"], r["price"], r["extra"]) for r in records]
    assert order == sorted(order)
    back = read_bids(spark, str(tmp_path / "log")).drop("key")
    assert bid.exceptAll(back).isEmpty() and back.count() == 400


def test_a_laid_out_log_leaves_no_lines(spark):
    before = set(Path(workspace.root(spark)).iterdir())
    found = registry.queries()["replicated_log"](spark, "/root/testdata/sf0.001")
    assert found.count() == 6000
    assert [p.name.split("-")[0] for p in set(Path(workspace.root(spark)).iterdir()) - before] == ["replicated"]
