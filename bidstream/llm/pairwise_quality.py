"""Quality by Bradley-Terry ranking of documents.

A document's score is linear in features of its bytes, words, lines and repetitions. The weights are
learned from preference pairs: of a good and a bad document the good one wins with probability
sigmoid(difference of scores), so the loss is logistic in differences of features. A quantile of the
training scores, at the share of bad documents, is the threshold; scores map to (0, 1) by a logistic
curve that passes through ``CUT`` there.

Every labelled training document is learned from: documents are dealt by hash into blocks that hold both
labels, and each plays up to ``ROUNDS`` games against documents of the other label of its block, the rarer
label's documents more of them. Tasks turn whole texts into features, once, and sum gradients per block; only
such sums, moments and the quantile reach the driver. Sums are exact, so the order of rows does not matter.

Defined cases: null and empty texts have the features of an empty text; if either label is missing in
training, every score is the label's that is there (1 if none is). Whole texts are scored. Labels that are
null or neither 0 nor 1 are ignored; of an id labelled twice the larger label counts, and of an id with several
rows the text of the smallest hash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream import workspace
from bidstream.llm.logistic import Linear, descend, sigmoid
from bidstream.llm.tables import ship, stored
from bidstream.llm.texts import mixed, slices
from bidstream.operators.ordering import numbered

BLOCK = 2_000  # documents of the commoner label in a block
ROUNDS = 8
RIDGE = 1e-3  # per game
CUT = 0.7

_CLASSES = {
    "symbols": b"#*$%&|<>", "marks": b".,;:", "shouts": b"!?", "digits": b"0123456789",
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "wide": bytes(range(128, 256)), "lines": b"\n",
}
_MEMBERS = np.stack([np.isin(np.arange(256), list(c)) for c in _CLASSES.values()])


def scores(docs: DataFrame, labels: DataFrame, held_out: Column, train: Column, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    spark = docs.sparkSession
    ship(spark)
    with workspace.temporary(spark) as keep:
        rows = docs.select(
            F.col("doc_id").cast("long"), held_out.alias("held_out"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
        described = stored(rows.mapInArrow(_described, _DESCRIBED), "features", keep)
        model = train_model(stored(labelled(described, labels, label, train), "training"))
    scored = described.select("doc_id", "held_out", "x").mapInArrow(
        partial(_scored, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def labelled(described: DataFrame, labels: DataFrame, label: str, train: Column) -> DataFrame:
    """doc_id, label and features x of every training document; ``train`` is a condition on labels.doc_id."""
    usable = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("label"))
    # Tasks keep one row of an id before the shuffle.
    first = described.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("version", "x")).alias("first"))
    return first.join(usable, "doc_id").select("doc_id", "label", "first.x")


def features(column) -> np.ndarray:
    """One row of features per text of an Arrow column."""
    return np.concatenate([_of_slice(part) for part in slices(column)] or [np.zeros((0, len(_CLASSES) + 10))])


def _of_slice(part):
    n = len(part)
    sizes = np.diff(part.offsets)
    size = np.maximum(sizes, 1)
    per_row = lambda rows, weights=None: np.bincount(rows, weights=weights, minlength=n)
    counts = np.bincount(np.repeat(np.arange(n) << 8, sizes) + part.data, minlength=n << 8).reshape(n, 256)
    shares = (counts @ _MEMBERS.T.astype(float)) / size[:, None]
    low = part.lower()
    starts, ends, row = low.words()
    words = per_row(row)
    word = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = per_row(row, length) / word
    deviation = np.sqrt(np.maximum(per_row(row, length * length) / word - mean * mean, 0))
    h = low.span_hashes(starts, ends)
    last = _MEMBERS[:, part.data[ends - 1]] if len(ends) else np.zeros((len(_MEMBERS), 0), bool)
    symbols, shouts = list(_CLASSES).index("symbols"), list(_CLASSES).index("shouts")
    threes = np.zeros(0, np.uint64)
    three_row = row[:0]
    if len(h) > 2:
        whole = row[2:] == row[:-2]
        threes = mixed(h[:-2] * np.uint64(3) + mixed(h[1:-1] * np.uint64(5) + mixed(h[2:])))[whole]
        three_row = row[2:][whole]

    def distinct(h, row):
        _, first = np.unique(mixed(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        return per_row(row[first])

    line_hash, line_row = _lines(part)
    lines = np.maximum(per_row(line_row), 1)
    return np.column_stack([
        shares, np.log1p(words), np.log1p(sizes / lines), mean, deviation,
        per_row(row[last[symbols]]) / word, per_row(row[last[shouts]]) / word,
        per_row(row[length == 1]) / word,
        np.log1p(distinct(h, row)) / np.log1p(word), distinct(threes, three_row) / np.maximum(per_row(three_row), 1),
        distinct(line_hash, line_row) / lines,
    ])


def _lines(part):
    """Fingerprints and rows of lines that are not empty."""
    if not len(part.data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.zeros(len(part.data) + 1, bool)
    cut[part.offsets] = True
    inside = part.data != 10
    before = cut[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = cut[1:].copy()
    after[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return part.span_hashes(starts, ends), np.searchsorted(part.offsets, starts, "right") - 1


_DESCRIBED = "doc_id long, held_out boolean, version long, x array<double>"


def _described(batches):
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "held_out", "version")], pa.array(list(x), pa.list_(pa.float64()))],
            ["doc_id", "held_out", "version", "x"])


def _rows_of(column):
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, len(_CLASSES) + 10))


# --- training ------------------------------------------------------------------------------------

def train_model(rows: DataFrame):
    """Score and its map to (0, 1) from doc_id, label and x; a number if a label is missing."""
    found = dict(rows.groupBy("label").count().collect())
    if len(found) < 2:
        return float(next(iter(found), 1))
    counts = found[0], found[1]
    mean, scale = moments(rows, sum(counts))
    weights = fit_games(stored(_blocks(rows, counts, mean, scale), "games"), len(mean))
    values = stored(rows.mapInArrow(partial(_values, model=Linear(mean, scale, weights, 0.0)), "label int, value double"), "values")
    threshold = quantile(values, counts[0] / sum(counts), sum(counts))
    steep = max(1e-3, steepness(values, threshold, 40 * np.abs(weights).sum(), sum(counts)))
    # sigmoid(steep * (score - threshold) + logit(CUT))
    bias = np.log(CUT / (1 - CUT)) - steep * threshold
    return Linear(mean, scale, steep * weights, bias)


def _sum(column):
    """A sum that does not depend on the order of rows."""
    return F.sum(column.cast("decimal(38,18)"))


def moments(rows, n):
    """Means and standard deviations of x over all rows."""
    x = [F.col("x")[i] for i in range(len(_CLASSES) + 10)]
    mean = np.array([float(v) for v in rows.agg(*[_sum(c) for c in x]).first()]) / n
    squares = rows.agg(*[_sum((c - F.lit(float(m))) * (c - F.lit(float(m)))) for c, m in zip(x, mean)]).first()
    return mean, np.sqrt(np.array([float(v) for v in squares]) / n) + 1e-9


def _blocks(rows, counts, mean, scale):
    """(games, good, bad) of each block: standardised features of its documents, in hash order.

    Each label is dealt in turn over all blocks; a label of fewer documents than blocks goes round again.
    """
    blocks = max(1, -(-max(counts) // BLOCK))
    own = F.when(F.col("label") == 0, F.lit(counts[0])).otherwise(F.lit(counts[1]))
    placed = numbered(rows.withColumn("key", F.xxhash64("doc_id")), ["label", "key", "doc_id"], "place").withColumn(
        "place", F.col("place") - F.col("label") * counts[0])
    block = F.when(own >= blocks, F.array(F.col("place") % blocks)).otherwise(
        F.sequence(F.least(F.col("place"), F.lit(blocks - 1)), F.lit(blocks - 1).cast("long"), own.cast("long")))
    dealt = placed.select("label", "place", "x", F.explode(block).alias("block"))
    return dealt.groupBy("block").applyInArrow(
        partial(_standardised, mean=mean, scale=scale), "games long, good binary, bad binary")


def _standardised(table, mean, scale):
    table = table.sort_by([("label", "ascending"), ("place", "ascending")]).combine_chunks()
    z = np.clip((_rows_of(pa.concat_arrays(table.column("x").chunks)) - mean) / scale, -20, 20)
    y = table.column("label").to_numpy()
    good, bad = z[y == 1], z[y == 0]
    return pa.table({"games": pa.array([len(games(good, bad))], pa.int64()), "good": [good.tobytes()], "bad": [bad.tobytes()]})


def games(good, bad):
    """Differences of features: each document of the commoner label against the next few of the other."""
    most, least = max(len(good), len(bad)), min(len(good), len(bad))
    first = np.tile(np.arange(most), min(ROUNDS, least))
    second = (first + np.repeat(np.arange(min(ROUNDS, least)), most)) % least
    return good[first] - bad[second] if len(good) >= len(bad) else good[second] - bad[first]


def fit_games(blocks, size):
    """Weights with which good documents win; each step sums gradient and curvature over all blocks."""
    total = blocks.agg(F.sum("games")).first()[0]
    # Standardised features differ by 40 at most: sums of longs at this scale are exact and do not overflow.
    unit = 2.0 ** np.floor(62 - np.log2(1600.0 * total))

    def at(w):
        found = _summed(blocks, partial(_slopes, w=w, unit=unit)) / unit
        return found[:size], found[size:].reshape(size, size)

    return descend(at, np.full(size, RIDGE * total))


def _summed(rows, sums):
    """The array that ``sums`` makes of each task's rows, added up."""
    parts = rows.mapInArrow(sums, "sums array<long>").select(F.posexplode("sums").alias("at", "sum"))
    return np.array([r[1] for r in sorted(parts.groupBy("at").agg(F.sum("sum")).collect())], float)


def _slopes(batches, w, unit):
    sums = np.zeros(len(w) * (len(w) + 1), np.int64)
    for batch in batches:
        for good, bad in zip(batch.column("good"), batch.column("bad")):
            d = games(*[np.frombuffer(side.as_buffer(), float).reshape(-1, len(w)) for side in (good, bad)])
            p = sigmoid(d @ w)
            curvature = (d * (p * (1 - p))[:, None]).T @ d
            sums += np.rint(np.append(d.T @ (p - 1), curvature) * unit).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], ["sums"])


def quantile(values, share, n):
    """The quantile of ``value`` between the two nearest rows, as numpy's."""
    at = (n - 1) * share
    low = int(at)
    near = numbered(values.select("value"), ["value"], "place").where(F.col("place").between(low, low + 1))
    found = sorted(r.value for r in near.select("value").collect())
    return found[0] + (found[-1] - found[0]) * (at - low)


def steepness(values, threshold, widest, n):
    """Slope of the logistic curve of labels over values that differ from the threshold by ``widest`` at most."""
    unit = 2.0 ** np.floor(62 - np.log2(max(1.0, widest * widest) * n))

    def at(w):
        found = _summed(values, partial(_curve, w=w, threshold=threshold, unit=unit)) / unit
        return found[:1], found[1:, None]

    return descend(at, np.ones(1))[0]


def _curve(batches, w, threshold, unit):
    sums = np.zeros(2, np.int64)
    for batch in batches:
        x = batch.column("value").to_numpy() - threshold
        p = sigmoid(w[0] * x)
        # Rounded row by row, whatever the batches.
        sums += [np.rint(v * unit).astype(np.int64).sum() for v in ((p - batch.column("label").to_numpy()) * x, p * (1 - p) * x * x)]
    yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.int64()))], ["sums"])


def _values(batches, model):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(model(_rows_of(batch.column("x"))), pa.float64())], ["label", "value"])


def _scored(batches, model):
    for batch in batches:
        x = _rows_of(batch.column("x"))
        values = sigmoid(model(x)) if isinstance(model, Linear) else np.full(len(x), model)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64())],
            ["doc_id", "held_out", "score"])
