import json

from bidstream.__main__ import main
from bidstream.sinks import as_json_lines
from bidstream.sources.events import multiplex, record_count
from bidstream.sources.tables import from_warehouse

SF = "/root/testdata/sf0.001"


def test_prepare_scan_replay(spark, tmp_path, capsys):
    events = multiplex(from_warehouse(spark, SF))
    events.select(as_json_lines(events).alias("value")).write.text(str(tmp_path / "events"))
    log, out = str(tmp_path / "bids.jsonl"), str(tmp_path / "report")
    assert main(["prepare", "--events", str(tmp_path / "events"), "--output", log,
                 "--rows", "5000", "--partitions", "4"]) == 0
    assert record_count(spark, log) == 5000
    capsys.readouterr()
    assert main(["scan", log]) == 0
    stats = json.loads(capsys.readouterr().out)
    assert (stats["total_rows"], stats["partitions"]) == (5000, 4)
    for sink in ("table", "discard"):
        assert main(["replay", "--dataset", log, "--queries", "q2_r,q21_r_anywhere,q16_r",
                     "--sink", sink, "--report", out]) == 0
    shown = capsys.readouterr().out
    assert "| q16_r | finished | 5000 |" in shown
    rows = spark.read.json(f"{out}/metrics.json").collect()
    assert {r.query for r in rows} == {"q2_r", "q21_r_anywhere", "q16_r"}
    assert all(r.state == "finished" for r in rows)
