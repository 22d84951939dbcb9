"""Staging deals rows to files without a sort, and every slice has all its files."""

from contextlib import redirect_stdout
from io import StringIO

from bidstream import workspace
from bidstream.streaming.replay import dealt, stage
from conftest import at


def test_every_slice_has_its_files(spark, make, tmp_path):
    bid = [dict(ts=at(f"10:0{m}:00"), auction=1, bidder=m, price=1) for m in (0, 0, 0, 9)]
    stage(make(bid)._replace(auction=None, person=None), str(tmp_path), slices=3, files=4)
    for part in ("data-0", "data-1", "data-2", "end-0", "end-1"):
        assert sum(n.endswith(".parquet") for n in workspace.names(spark, f"{tmp_path}/bid/{part}")) == 4
    assert spark.read.parquet(f"{tmp_path}/bid/data-*").count() == 4


def test_rows_are_not_dealt_in_turn(spark, make):
    text = StringIO()
    with redirect_stdout(text):
        dealt(make([dict(auction=1)]).bid, 4).explain()
    # Dealing in turn sorts the rows of each task before the shuffle.
    assert "RoundRobin" not in text.getvalue() and "hashpartitioning" in text.getvalue()
