"""q5 as a stream: counts per pane in stores instead of a row of state per window, and no late row is lost."""

import pytest
from pyspark.sql import functions as F

from bidstream.functions import hop_starts
from bidstream.operators import rows_at_max
from bidstream.operators.hops import hop_panes, merged_panes, window_counts
from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.schemas import BID
from bidstream.sources.tables import Tables
from bidstream.streaming import FORMS, result, start
from conftest import at, values
from test_streams import same

BIDS = [("10:00:10", 1), ("10:00:12", 1), ("10:00:35", 3), ("10:00:05", 1), ("10:00:11", 2), ("10:00:30", None), ("10:00:03", 2),
        ("10:00:03", 2), ("10:00:20", 2), (None, 2), ("1969-12-31T23:59:59", 7), ("10:00:31", None), ("10:00:40", 1), ("10:05:00", 4)]


@pytest.mark.parametrize("size, slide", [("10 seconds", "2 seconds"), ("10 seconds", "10 seconds"), ("7 seconds", "3 seconds"), ("2 seconds", "5 seconds")])
def test_counts_from_panes_equal_a_row_per_window(make, size, slide):
    bid = make([dict(auction=a, ts=t and at(t)) for t, a in BIDS]).bid
    expected = (bid.where("ts IS NOT NULL").select("auction", F.explode(hop_starts("ts", size, slide)).alias("starttime"))
                .groupBy("auction", "starttime").agg(F.count(F.lit(1)).alias("num")))
    halves = [hop_panes(bid.where(half), "auction", "ts", size, slide) for half in ("second(ts) % 2 = 0", "second(ts) % 2 = 1")]
    panes = halves[0].unionByName(halves[1])
    for given in (panes, merged_panes(panes, "auction")):
        assert same(window_counts(given, "auction", slide), expected)


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_no_state_is_held_and_late_rows_count(spark, make, tmp_path, broadcast_rows):
    p = Params(broadcast_rows=broadcast_rows)
    for n in range(0, len(BIDS), 4):
        bid = make([dict(auction=a, ts=t and at(t)) for t, a in BIDS[n:n + 4]]).bid
        bid.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    tables = Tables(spark.readStream.schema(BID).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = start(FORMS["q5"], tables, f"{tmp_path}/store", f"{tmp_path}/cp", p, fan=2)
    query.awaitTermination()
    assert len(query.recentProgress) >= 4 and not any(x["stateOperators"] for x in query.recentProgress)
    assert same(result(FORMS["q5"], tables, spark, f"{tmp_path}/store", p), CATALOG["q5"](Tables(spark.read.parquet(f"{tmp_path}/in")), p))


def test_few_maxima_are_shipped_and_many_are_not(spark):
    rows = spark.range(60).select((F.col("id") % 6).alias("g"), (F.col("id") % 4).alias("v"), "id")
    expected = values(rows_at_max(rows, "g", "v"), "g", "v", "id")
    for few, ranked in ((6, False), (5, True)):
        found = rows_at_max(rows, "g", "v", few=few)
        assert values(found, "g", "v", "id") == expected
        assert ("Window" in found._jdf.queryExecution().executedPlan().toString()) == ranked
