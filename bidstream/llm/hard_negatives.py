"""Hard negatives by angular triangle filtering.

For each anchor the ``POSITIVES`` best rows of its label are found, and for each of them the ``NEGATIVES``
best rows of other labels whose score lies between ``LEAST`` per cent of the positive's and all of it.
The score is the integer inner product of floors (floor(256 * x)); ties go to the smaller id.

1. Reference directions, at most ``CELLS``, are distinct vectors of the smallest hashes. A vector belongs to
   the cell of its nearest direction and stores its angles to that one and to ``GUIDES`` common ones.
2. Cells are cut by hash into blocks of about ``BLOCK`` rows. Equal vectors of one label meet there and are
   one entry with its smallest ids, so a vector that fills a third of the table is scored once.
3. The triangle inequality on the sphere bounds the angle of two vectors by their angles a and b to one
   direction: |a - b| <= angle <= min(a + b, 2 pi - a - b). The tightest over all directions, times the norms
   and widened for rounding, bounds the score. On cells it decides which blocks an anchor visits; inside a
   block only entries whose interval overlaps a window of wanted scores get integer scoring, and
   a window shrinks to the best found so far.
4. Anchors search their own cell for positives first; the worst of those is the bound with which they visit
   the other cells. Negatives are searched with the windows of all positives at once.

A task holds one block and lets the anchors that visit it stream by, in order of (cell, block): entries
are shipped once per pass and an anchor once per block its bounds allow. The driver gets the
reference directions and four numbers per cell.

Defined cases: see ``integer_vectors.usable`` for vectors that take no part; neither do rows of null id or
null label. Rows equal in id, label and vector are one row. Anchors are rows, so an id with two
vectors is two anchors; rows of an anchor's own id are no positives or negatives of it. Anchors without
positives give no rows. Zero vectors score 0 with everything. Only the three named columns are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidstream.llm.integer_vectors import floors, matrix, packed, unpacked, usable
from bidstream.llm.tables import ship, smallest, stored
from bidstream.llm.texts import mixed

POSITIVES = NEGATIVES = 5
LEAST = 80
CELLS, GUIDES = 256, 8
CELL_ROWS = 256  # no more cells than rows divided by this
BLOCK = 16_384
_TILE, _ANCHORS = 4096, 256
_PAD = 1e-6  # radians; far above the error of an arc cosine in doubles
_NONE = np.iinfo(np.int64).min
_FAR = 1 << 62  # beyond any score

_ENTRY = "cell int, sub int, kind int, anchor long, id long, label long, packed binary, ids array<long>, norm double, angles array<double>, windows array<long>"
_VISIT = "cell int, sub int, anchor long, id long, label long, packed binary, windows array<long>"
_HIT = "anchor long, window int, score long, id long"


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
                   id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. ``anchors`` is a
    condition on ``id_column``; labels are whole numbers."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"), anchors.alias("asks"))
    rows, width = usable(rows)
    rows = stored(rows.select("id", "label", floors().alias("v"), "asks"), "integer-vectors")
    directions = _directions(rows, width, rows.count())
    entries = stored(rows.mapInArrow(partial(_entries, directions=directions, keep=max(positives, negatives) + 1), _ENTRY), "entries")
    cells = _cells(entries, len(directions))
    subs = F.get(F.array(*map(F.lit, cells["subs"].tolist())), F.col("cell"))
    # Equal vectors share a hash, hence a block.
    entries = entries.withColumn("sub", F.pmod(F.xxhash64("packed"), subs).cast("int"))
    asked = rows.where("asks").select("id", "label", "v").dropDuplicates()
    asked = stored(asked.mapInArrow(partial(_anchors, width=width), "id long, label long, packed binary"), "anchors")
    asked = stored(asked.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    search = partial(_searched, entries, directions=directions, cells=cells, width=width)

    # Windows are triples of number, least and most score.
    windows = lambda worst: F.array(F.lit(0).cast("long"), F.coalesce(worst, F.lit(-_FAR)), F.lit(_FAR))
    home = search(asked.withColumn("windows", windows(F.lit(None).cast("long"))), visit="home", same=True, k=positives)
    home = stored(_best(home, positives), "positives")
    worst = home.where(F.col("place") == positives).select("anchor", F.col("score").alias("worst"))
    asked_again = asked.join(worst, "anchor", "left").withColumn("windows", windows(F.col("worst"))).drop("worst")
    away = search(asked_again, visit="away", same=True, k=positives)
    best = _best(home.drop("place").unionByName(away), positives)
    best = stored(best.select(
        "anchor", F.col("place").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Scores from LEAST per cent on, rounded up; below zero no score is both above that and below the positive's.
    low = F.expr(f"(positive_score * {least} + 99) div 100")
    wanted = best.where("positive_score >= 0").groupBy("anchor").agg(F.flatten(F.sort_array(F.collect_list(
        F.array(F.col("window").cast("long"), low, "positive_score")))).alias("windows"))
    found = _best(search(asked.join(wanted, "anchor"), visit="all", same=False, k=negatives), negatives)
    return (
        found.join(best, ["anchor", "window"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
    )


def _best(hits, k):
    """Hits of each anchor and window in order, the first ``k``; tasks drop the others before the shuffle."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# --- directions, entries and cells ---------------------------------------------------------------

def _directions(rows, width, count):
    """Unit vectors of distinct rows of the smallest hashes; one axis if there are none."""
    n = int(min(CELLS, max(1, count // CELL_ROWS)))
    if not width:
        return np.zeros((1, 0))
    few = rows.select("v").mapInArrow(partial(_few_distinct, width=width, n=n), "hash long, packed binary")
    few = smallest(few.dropDuplicates(["hash"]), [F.col("hash")], n)
    found = unpacked([r.packed for r in few], width).astype(float)
    return found / np.linalg.norm(found, axis=1)[:, None] if len(found) else np.eye(1, width)


def _few_distinct(batches, width, n):
    """Of a task, the vectors of the ``n`` smallest hashes, each once; zero vectors have no direction."""
    held = {}
    for batch in batches:
        rows = matrix(batch.column("v"), width)
        rows = rows[rows.any(axis=1)]
        h = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        least, first = np.unique(h.view(np.int64), return_index=True)
        held |= zip(least[:n].tolist(), packed(rows[first[:n]]))
        held = dict(sorted(held.items())[:n])
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.binary())], ["hash", "packed"])


def _angles(rows, directions):
    """Norms, and angles to all directions; those of a zero vector are right angles."""
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    cosines = rows @ directions.T / np.maximum(norms, 1e-300)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1))


def _entries(batches, directions, keep):
    """Distinct vectors of a batch and label with their smallest ids and their angles."""
    width = directions.shape[1]
    for batch in batches:
        held = {}
        ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
        for key, some in zip(zip(packed(matrix(batch.column("v"), width)), labels), ids):
            held.setdefault(key, set()).add(some)
        vectors = unpacked([v for v, _ in held], width)
        norms, angles = _angles(vectors, directions)
        cell = angles.argmin(axis=1) if len(held) else np.zeros(0, np.int64)
        own = np.column_stack([angles[np.arange(len(cell)), cell], angles[:, :GUIDES]])
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell, pa.int32()), pa.nulls(len(held), pa.int32()), pa.array(np.zeros(len(held)), pa.int32()), none, none,
             pa.array([label for _, label in held], pa.int64()), pa.array([v for v, _ in held], pa.binary()),
             pa.array([sorted(s)[:keep] for s in held.values()], pa.list_(pa.int64())),
             pa.array(norms, pa.float64()), pa.array(list(own), pa.list_(pa.float64())), pa.nulls(len(held), pa.list_(pa.int64()))],
            ["cell", "sub", "kind", "anchor", "id", "label", "packed", "ids", "norm", "angles", "windows"])


def _cells(entries, count):
    """Range of angles and of norms, and number of blocks, of each cell."""
    angle = F.get("angles", F.lit(0))
    found = entries.groupBy("cell").agg(F.min(angle), F.max(angle), F.min("norm"), F.max("norm"), F.count(F.lit(1))).collect()
    cells = {name: np.zeros(count) for name in ("near", "far", "short", "long")} | {"subs": np.zeros(count, np.int64)}
    for cell, near, far, short, long, rows in found:
        for name, value in zip(cells, (near, far, short, long, -(-rows // BLOCK))):
            cells[name][cell] = value
    return cells


def _anchors(batches, width):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(packed(matrix(batch.column("v"), width)), pa.binary())],
            ["id", "label", "packed"])


# --- search --------------------------------------------------------------------------------------

def _searched(entries, asked, directions, cells, width, visit, same, k):
    """Best hits of each anchor, window and visited block."""
    spark = entries.sparkSession
    kinds = {f.name: f.dataType for f in entries.schema}
    visits = asked.select("anchor", "id", "label", "packed", "windows").mapInArrow(
        partial(_visits, directions=directions, cells=cells, visit=visit), _VISIT)
    visits = visits.select(*[F.col(c) if c in visits.columns else F.lit(1 if c == "kind" else None).cast(kinds[c]).alias(c) for c in entries.columns])
    blocks = max(1, int(cells["subs"].sum()))
    met = entries.unionByName(visits).repartition(max(blocks, spark.sparkContext.defaultParallelism), "cell", "sub")
    return met.sortWithinPartitions("cell", "sub", "kind").mapInArrow(
        partial(_met, directions=directions, width=width, same=same, k=k), _HIT)


def _bounds(near, far, norms, short, long):
    """Least and most score at angles within [near, far] and norms within [short, long], rounding included."""
    low, high = np.cos(np.minimum(np.pi, far + _PAD)), np.cos(np.maximum(0, near - _PAD))
    low = norms * np.where(low < 0, long, short) * low
    high = norms * np.where(high < 0, short, long) * high
    return low - 1 - 1e-9 * np.abs(low), high + 1 + 1e-9 * np.abs(high)


def _visits(batches, directions, cells, visit):
    """A row per anchor and block that may hold a wanted score."""
    width = directions.shape[1]
    subs = cells["subs"]
    for batch in batches:
        for first in range(0, len(batch), _ANCHORS):
            some = batch.slice(first, _ANCHORS)
            norms, angles = _angles(unpacked(some.column("packed").to_pylist(), width), directions)
            home = np.zeros(angles.shape, bool)
            home[np.arange(len(home)), np.where(subs > 0, angles, 9).argmin(axis=1)] = True
            near = np.maximum(0, np.maximum(angles - cells["far"], cells["near"] - angles))
            low, high = _bounds(near, np.minimum(np.pi, angles + cells["far"]), norms[:, None], cells["short"], cells["long"])
            wanted = np.zeros(angles.shape, bool)
            for i, windows in enumerate(some.column("windows").to_pylist()):
                for least, most in zip(windows[1::3], windows[2::3]):
                    wanted[i] |= (high[i] >= least) & (low[i] <= most)
            wanted = {"home": home, "away": wanted & ~home, "all": wanted}[visit] & (subs > 0)
            row, cell = np.nonzero(wanted)
            row, cell = np.repeat(row, subs[cell]), np.repeat(cell, subs[cell])
            change = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))) if len(row) else row
            sub = np.arange(len(row)) - np.repeat(change, np.diff(np.append(change, len(row))))
            for a in range(0, len(row), 1 << 14):
                part = some.take(pa.array(row[a: a + (1 << 14)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[a: a + (1 << 14)], pa.int32()), pa.array(sub[a: a + (1 << 14)], pa.int32()), *part.columns],
                    ["cell", "sub", *part.schema.names])


def _met(batches, directions, width, same, k):
    """Entries of a block are gathered, then its visitors are answered as they come."""
    here, held, block = None, [], None
    for batch in batches:
        cell, sub, kind = (batch.column(c).to_numpy() for c in ("cell", "sub", "kind"))
        changes = np.flatnonzero((cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (kind[1:] != kind[:-1])) + 1
        for first, last in zip([0, *changes], [*changes, len(batch)]):
            some = batch.slice(first, last - first)
            if not len(some):
                continue
            if here != (cell[first], sub[first]):
                here, held, block = (cell[first], sub[first]), [], None
            if kind[first] == 0:
                held.append(some)
                continue
            if block is None and held:
                block, held = _Block(held, width, k), []
            for a in range(0, len(some) if block else 0, _ANCHORS):
                yield block.answered(some.slice(a, _ANCHORS), directions, int(here[0]), same, k)


class _Block:
    """The distinct entries of one block."""

    def __init__(self, batches, width, k):
        held, angles = {}, {}
        for b in batches:
            for v, label, ids, own in zip(*(b.column(c).to_pylist() for c in ("packed", "label", "ids", "angles"))):
                held.setdefault((v, label), set()).update(ids)
                angles[v, label] = own
        self.vectors = unpacked([v for v, _ in held], width)
        self.label = np.array([label for _, label in held])
        self.ids = [sorted(s)[: k + 1] for s in held.values()]
        self.first = np.array([s[0] for s in self.ids])
        self.only = np.array([s[0] if len(s) == 1 else _NONE for s in self.ids])
        self.angles = np.array(list(angles.values()))
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))

    def answered(self, asked, directions, cell, same, k):
        vectors = unpacked(asked.column("packed").to_pylist(), self.vectors.shape[1])
        label, own = asked.column("label").to_numpy(), asked.column("id").to_numpy()
        norms, angles = _angles(vectors, directions)
        angles = np.column_stack([angles[:, cell], angles[:, :GUIDES]])
        windows = [list(zip(w[::3], w[1::3], w[2::3])) for w in asked.column("windows").to_pylist()]
        best = [[[] for _ in w] for w in windows]
        least = [[low for _, low, _ in w] for w in windows]
        for a in range(0, len(self.vectors), _TILE):
            tile = slice(a, a + _TILE)
            near = np.zeros((len(asked), len(self.norms[tile])))
            far = np.full_like(near, np.pi)
            for x, y in zip(angles.T, self.angles[tile].T):
                np.maximum(near, np.abs(x[:, None] - y), out=near)
                both = x[:, None] + y
                np.minimum(far, np.minimum(both, 2 * np.pi - both), out=far)
            low, high = _bounds(near, far, norms[:, None], self.norms[tile], self.norms[tile])
            open_ = ((self.label[tile] == label[:, None]) == same) & (self.only[tile] != own[:, None])
            for i in range(len(asked)):
                overlap = np.zeros(near.shape[1], bool)
                for at_least, (_, _, most) in zip(least[i], windows[i]):
                    overlap |= (high[i] >= at_least) & (low[i] <= most)
                some = a + np.flatnonzero(overlap & open_[i])
                if not len(some):
                    continue
                score = _products(self.vectors[some], vectors[i])
                for w, (_, _, most) in enumerate(windows[i]):
                    fits = np.flatnonzero((score >= least[i][w]) & (score <= most))
                    if not len(fits):
                        continue
                    if len(fits) > 4 * k:  # ties with the last place stay
                        cut = np.partition(score[fits], len(fits) - k - 1)[len(fits) - k - 1]
                        fits = fits[score[fits] >= cut]
                    fits = fits[np.lexsort((self.first[some[fits]], -score[fits]))][: k + 1]
                    more = [(-int(score[f]), x) for f in fits for x in self.ids[some[f]] if x != own[i]]
                    best[i][w] = sorted(best[i][w] + more)[:k]
                    if len(best[i][w]) == k:
                        least[i][w] = max(least[i][w], -best[i][w][-1][0])
        anchor = asked.column("anchor").to_pylist()
        hits = [(anchor[i], windows[i][w][0], -s, x) for i in range(len(asked)) for w in range(len(windows[i])) for s, x in best[i][w]]
        columns = list(zip(*hits)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "window", "score", "id"])


def _products(rows, vector):
    """Exact inner products: in doubles while all sums stay below 2^53."""
    if len(vector) * float(np.abs(rows).max(initial=0)) * float(np.abs(vector).max(initial=0)) < 1 << 53:
        return (rows.astype(float) @ vector.astype(float)).astype(np.int64)
    return rows @ vector
