"""Start a form, and read its answer."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from bidstream import workspace
from bidstream.params import Params
from bidstream.sinks import store as stores
from bidstream.sinks.stream import query_id
from bidstream.sources.tables import Tables
from bidstream.streaming import closing, kept
from bidstream.streaming.forms import Form
from bidstream.streaming.salts import remembered


def start(
    form: Form, tables: Tables, store: str, checkpoint: str, p: Params = Params(),
    name: str | None = None, trigger: dict | None = None, state_partitions: int | None = None,
    fan: int = 8,
):
    """Run a form over streaming tables, adding each micro-batch to the store at ``store``.

    A batch that is retried after a failure counts once. Rows of forms with ``merge`` are merged in
    levels of ``fan`` parts while the stream runs (see ``sinks.store``), so the store follows the
    number of groups. The default trigger reads all that is available and then stops by itself.
    ``state_partitions`` (default: one per core) is fixed by the first run of a checkpoint.
    The sides of a join without a bound on time are kept beside the checkpoint (see ``kept``), and so are the
    open auctions of a form that closes them, with ``keep_open`` (see ``closing``).
    """
    spark = _session(tables)
    p = remembered(spark, p, checkpoint)
    sides = form.keeps_sides(p)
    opens = form.keeps_open(p)
    _check_state(spark, form, opens, checkpoint)
    if sides:
        rows = kept.tagged(*form.sides(tables, p))
    else:
        rows = kept.tagged(*closing.sides(tables, form.closes[0])) if opens else form.plan(tables, p)
    merge = None if form.merge is None else lambda stored: form.merge(stored, p)

    def keep(batch: DataFrame, batch_id: int) -> None:
        owner = query_id(batch.sparkSession, checkpoint)
        if sides:
            batch = kept.completed(
                spark, batch, batch_id, f"{checkpoint}-sides", owner,
                lambda many, one: form.pairs(many, one, p), fan)
        if opens:
            batch = closing.settled(
                spark, batch, batch_id, f"{checkpoint}-open", owner, *form.closes, p.watermark_delay,
                p.hot_auctions, p.join_salts)
        held = batch.persist() if form.reread else batch
        try:
            out = held if form.batch is None else form.batch(held, p)
            stores.add(out, batch_id, store, owner, merge, fan)
        finally:
            if form.reread:
                held.unpersist()

    writer = rows.writeStream.outputMode(form.mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.foreachBatch(keep).trigger(**(trigger or {"availableNow": True}))
    # A query copies the session settings when it starts.
    with _setting(
        spark, "spark.sql.shuffle.partitions",
        state_partitions or spark.sparkContext.defaultParallelism,
    ):
        return writer.start()


def _check_state(spark, form, opens, checkpoint):
    """Open auctions are where the checkpoint began to keep them."""
    other = f"{checkpoint}/state" if opens else f"{checkpoint}-open"
    if form.closes is not None and workspace.exists(spark, other):
        raise ValueError(f"{checkpoint} began with keep_open={not opens}")


def _session(tables):
    return next(rows for rows in tables if rows is not None).sparkSession


@contextmanager
def _setting(spark: SparkSession, key: str, value):
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored_rows(form: Form, tables: Tables, spark: SparkSession, store: str, p: Params) -> DataFrame:
    """Everything stored by ``start``, with the schema known up front."""
    empty = form.plan(tables, p).schema
    rows = spark.createDataFrame([], empty)
    if form.batch is not None:
        rows = form.batch(rows, p)
    return stores.read(spark, store, rows.schema)


def result(
    form: Form, tables: Tables, spark: SparkSession, store: str, p: Params = Params(), keep=None,
) -> DataFrame:
    """The answer of a form from its stored rows, in the shape of the batch query."""
    rows = stored_rows(form, tables, spark, store, p)
    if keep is not None:
        rows = rows.where(keep)
    return rows if form.view is None else form.view(rows, p)


def compact(form: Form, tables: Tables, spark: SparkSession, store: str, into: str, p=Params()) -> None:
    """Merge all stored rows of a form with ``merge`` into one part, the whole of the store at ``into``."""
    if form.merge is None:
        raise ValueError("only forms with mergeable rows can be compacted")
    merged = form.merge(stored_rows(form, tables, spark, store, p), p)
    stores.add(merged, stores.current(spark, into).last + 1, into, replace=True)
