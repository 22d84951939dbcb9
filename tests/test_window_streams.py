"""q7 and q11 as streams: small mergeable rows, no state, and no late row is lost."""

import pytest

from bidstream.params import Params
from bidstream.plans import CATALOG
from bidstream.schemas import BID
from bidstream.sources.tables import Tables
from bidstream.streaming import FORMS, result, start
from conftest import at
from test_streams import same

P = Params()


@pytest.mark.parametrize("name", ["q7", "q11"])
def test_late_rows_count_and_no_state_is_held(spark, make, tmp_path, name):
    # The end of a window comes before, with and after its other rows; ties, and a higher bid that comes late.
    batches = [
        [("10:00:10", 1, 7), ("10:00:10", 2, 9), ("10:00:35", 3, 4)],
        [("10:00:05", 1, 7), ("10:00:12", 2, 9), ("10:00:30", 3, 4)],
        [("10:00:03", 1, 9), ("10:00:03", 1, 9), ("10:00:20", 2, 9), ("10:00:20", 2, None)],
        [("10:00:31", 3, 5), ("10:00:40", 1, 5), ("10:00:40", 1, 4)],
    ]
    for rows in batches:
        given = [dict(ts=at(t), auction=b, bidder=b, price=p) for t, b, p in rows]
        make(given).bid.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    tables = Tables(spark.readStream.schema(BID).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = start(FORMS[name], tables, f"{tmp_path}/store", f"{tmp_path}/cp", P, fan=2)
    query.awaitTermination()
    assert not any(p["stateOperators"] for p in query.recentProgress)
    assert same(result(FORMS[name], tables, spark, f"{tmp_path}/store", P),
                CATALOG[name](Tables(spark.read.parquet(f"{tmp_path}/in")), P))
