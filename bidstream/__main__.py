"""Command line: prepare a keyed bid log, scan its statistics, replay queries over it.

    python -m bidstream prepare --events EVENTS --output LOG --rows N --partitions P
    python -m bidstream scan LOG
    python -m bidstream replay --dataset LOG [--queries q0_r,q2_r] [--sink table|discard] [--report DIR]

Run it with ``spark-submit`` on a cluster; the session is taken from there.
"""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from bidstream import workspace
from bidstream.dataset import dataset_stats, expected_rows, first_bids, load_stats, save_stats
from bidstream.params import Params
from bidstream.sinks import discard_stream, write_keyed_lines
from bidstream.sources.events import demultiplex, read_bids, read_events, stream_bids
from bidstream.sources.tables import Tables
from bidstream.streaming import FORMS, configure_streaming, result, start
from bidstream.streaming.metrics import markdown, metrics_frame, report, run_and_measure, save_report

DEFAULT_QUERIES = "q0_r,q1_r,q2_r,q14_r,q21_r,q22_r,q16_r,q17_r"


def prepare(spark, args):
    bids = first_bids(demultiplex(read_events(spark, args.events)).bid, args.rows)
    write_keyed_lines(bids, args.output, args.partitions)
    print(save_stats(dataset_stats(read_bids(spark, args.output)), args.output))


def scan(spark, args):
    print(json.dumps(dataset_stats(read_bids(spark, args.dataset)).first().asDict(), indent=2))


def replay(spark, args):
    p = Params()
    stats = load_stats(spark, args.dataset)
    expected = expected_rows(stats)
    measured = []
    for name in args.queries.split(","):
        # Fresh folders per run, so that no run sees the state of another.
        folder = workspace.fresh(spark, f"replay-{name}")
        tables = Tables(stream_bids(spark, args.dataset, args.files_per_trigger).drop("key"))
        form = FORMS[name]
        # Reports are kept as mergeable rows, so they need the table sink.
        table = args.sink == "table" or form.view is not None

        def begin():
            if table:
                return start(form, tables, f"{folder}/store", f"{folder}/checkpoint", p, name)
            rows = form.plan(tables, p)
            writer = discard_stream(rows, name, f"{folder}/checkpoint", form.mode)
            return writer.trigger(availableNow=True).start()

        def inserted():
            return result(form, tables, spark, f"{folder}/store", p).count() if table else None

        measured.append(run_and_measure(name, begin, args.stall, expected.get(name), inserted))
    content = report("spark", spark.sparkContext.master, args.dataset, {}, stats, args.sink, measured)
    print(markdown(content))
    if args.report:
        save_report(spark, content, args.report)
        metrics_frame(spark, measured).write.mode("overwrite").json(f"{args.report}/metrics.json")
    return 0 if all(m["state"] == "finished" for m in measured) else 1


def parser():
    top = argparse.ArgumentParser(prog="bidstream")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("prepare", help="combined JSON events -> keyed bid log and statistics")
    one.add_argument("--events", required=True)
    one.add_argument("--output", required=True)
    one.add_argument("--rows", type=int, default=10_000_000)
    one.add_argument("--partitions", type=int, default=1)
    two = commands.add_parser("scan", help="print the statistics of a bid log")
    two.add_argument("dataset")
    three = commands.add_parser("replay", help="replay a bid log through queries and report")
    three.add_argument("--dataset", required=True)
    three.add_argument("--queries", default=DEFAULT_QUERIES)
    three.add_argument("--sink", choices=("table", "discard"), default="table")
    three.add_argument("--stall", type=float, help="stop after so many seconds without progress")
    three.add_argument("--files-per-trigger", type=int)
    three.add_argument("--report")
    return top


def main(argv=None):
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("bidstream").getOrCreate()
    configure_streaming(spark)
    return {"prepare": prepare, "scan": scan, "replay": replay}[args.command](spark, args) or 0


if __name__ == "__main__":
    sys.exit(main())
