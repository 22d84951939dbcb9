"""Mixing sources to target weights, by hash-random order and distributed prefix sums.

Every document gets a random key, the hash of its id, its text and a seed. Within a source the documents are
range-sorted by key: equal ranges of the key space, as many as the source's size asks for, hold about
equally many documents, so a source with a third of all rows is spread like any other. Sizes are
summed per range, the sums are prefix-summed over the ranges of a source, and documents only inside
their range. A source gives whole epochs as long as its budget holds them, and the documents whose
prefix sum lies within what is left; the one at the cut gives the words up to the exact budget.

Targets: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all
sizes. No source gives more than ``MOST`` times its size; the excess goes to the others by weight,
again and again. The fixed point is min(MOST * size, level * weight) for one level, found from the
sources sorted by the level at which they are exhausted.

Defined cases: null text has size 0, a source without words a target of 0. Rows of equal doc_id,
source and text share a key; they are interchangeable. A null doc_id is an id too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidstream.llm.tables import stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
RANGE_ROWS = 4096
_KEY_DIGITS = 8  # leading hex digits of the key that choose a range


def size_of(text: str | Column = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(seed: str = "mix") -> Column:
    """The text takes part, so that rows of one id, or of none, are spread like others."""
    return F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (source, source_size, rows) in; target added. Grows with the sources only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    # Sources exhausted at a lower level come first; those before row i give all they have.
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    steps = weighed.withColumn("level", left / open_weight)
    # The level is that of the first row not exhausted at its own; later rows only come lower.
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(whole)
    return steps.withColumn("reached", reached).select(
        "source", "source_size", "rows",
        F.least("most", F.coalesce(F.col("reached") * F.col("weight"), F.col("most"))).alias("target"),
    )


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    return _taken(docs.select("doc_id", "source", "text"), seed)


def _taken(docs, seed):
    """``mixed`` with the columns of ``docs`` but the text."""
    kept = [c for c in docs.columns if c != "text"]
    # A few numbers per document, counted once and read three times.
    sized = stored(docs.select(*kept, size_of().alias("size"), key_of(seed).alias("key")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / RANGE_ROWS))
    targets = source_targets(totals).select(
        F.col("source").alias("of_source"), "source_size", "target", ranges.alias("ranges"))
    place = F.conv(F.substring("key", 1, _KEY_DIGITS), 16, 10).cast("long")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).withColumn(
        "range", F.floor(place * F.col("ranges") / F.lit(16 ** _KEY_DIGITS)))
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inside", F.sum("size").over(within))
    by_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "range").agg(F.max("inside").alias("range_size")).select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("range_size").over(by_source), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size")
    start = F.col("offset") + F.col("inside") - F.col("size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    return rows.select(*kept, "size", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"))


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix as rows of ``docs``: each epoch of a document is a row, the last one cut at its budget."""
    known, columns = "taken", docs.columns
    while any(c.startswith(known) for c in docs.columns):
        known += "_"
    # Each row gets its own share, whatever other rows are equal to it.
    docs = stored(docs.withColumn(f"{known}row", F.monotonically_increasing_id()), "numbered")
    taken = _taken(docs.select("doc_id", "source", "text", f"{known}row"), seed).select(
        f"{known}row", F.col("size").alias(f"{known}size"), F.col("taken").alias(known))
    rows = docs.join(taken.where(F.col(known) > 0), f"{known}row")
    # Words left for each epoch: all of them, and at the last the rest.
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(known) / F.col(f"{known}size")) - 1).cast("int"))
    rows = rows.withColumn(f"{known}epoch", F.explode(epochs))
    words = F.least(F.col(f"{known}size"), F.col(known) - F.col(f"{known}epoch") * F.col(f"{known}size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), 1, words.cast("int")), "")
    text = F.when(words < F.col(f"{known}size"), cut).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])
