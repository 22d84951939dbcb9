"""Nearest neighbours by cosine, from low-dimensional stable projections indexed by kd-trees.

Unit vectors are projected with a Gaussian (2-stable) matrix to ``DIMENSIONS`` numbers. For a vector
at distance d of the query the squared projected distance over d^2 is chi-square with that many
degrees of freedom. A kd-tree over the projections yields neighbours of the projected query in
increasing distance; each is verified on the original vectors. The search ends when the next
projected distance is so large that a vector nearer than the k-th best would have been met before with
probability ``CONFIDENCE``: chi-square CDF of (next distance / k-th best)^2.

Every row is indexed. Equal vectors are collapsed first, each with its smallest ids, so that one vector
that fills a third of the table is one entry. Distinct vectors are dealt by hash into blocks, queries
into chunks; each pair of block and chunk is searched by one task, and the best of all blocks win.

Defined cases: vectors that are null, zero, of another length than most or with null or non-finite
components take no part. Null ids take no part. Rows of one id are candidates one by one.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.llm.tables import ship, stored
from bidstream.llm.texts import mixed

DIMENSIONS = 12
CONFIDENCE = 0.999
LEAF = 32
BLOCK_ROWS = 16_384
CHUNK_ROWS = 2_048
_STEP = 16  # leaves verified between two stopping tests

_DISTINCT = "part long, packed binary, ids array<long>"


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding",
            confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull())
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 0
    usable = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.where(usable), "vectors")
    partitions = spark.sparkContext.defaultParallelism
    # One row per distinct vector with the smallest ids, first per task, then per vector.
    distinct = rows.select("id", "v").mapInArrow(partial(_packed, k=k), _DISTINCT)
    count = max(partitions, -(-rows.count() // BLOCK_ROWS))
    distinct = stored(distinct.repartition(count, "part").mapInArrow(partial(_merged, k=k), _DISTINCT), "distinct")
    entries = distinct.count()
    blocks = max(1, -(-entries // BLOCK_ROWS))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v").distinct()
    asked = stored(queries.mapInArrow(_queries, "id long, part long, packed binary"), "queries")
    chunks = max(1, -(-asked.count() // CHUNK_ROWS))
    numbered = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = distinct.select(F.pmod("part", F.lit(blocks)).cast("int").alias("block"), numbered(chunks, "chunk"), "packed", "ids")
    right = asked.select(numbered(blocks, "block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"), "id", "packed")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        partial(_search, k=k, confidence=confidence), "query_id long, vec_id long, score double")
    # At most k rows per query and block meet here.
    best = found.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))


def _vectors(column):
    """Rows of doubles of a list column without nulls; all of one width."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _fingerprints(matrix):
    h = np.zeros(len(matrix), np.uint64)
    for column in np.ascontiguousarray(matrix.T).view(np.uint64):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return (h >> np.uint64(1)).view(np.int64)


def _packed(batches, k):
    """Distinct vectors of a task with their k + 1 smallest ids (a query is not its own answer)."""
    for batch in batches:
        matrix = _vectors(batch.column("v")) + 0.0  # -0.0 equals 0.0
        yield _collapsed(_fingerprints(matrix), [row.tobytes() for row in matrix], [[i] for i in batch.column("id").to_pylist()], k)


def _merged(batches, k):
    part, packed, ids = [], [], []
    for batch in batches:
        part.append(batch.column("part").to_numpy())
        packed += batch.column("packed").to_pylist()
        ids += batch.column("ids").to_pylist()
    if part:
        yield _collapsed(np.concatenate(part), packed, ids, k)


def _collapsed(part, packed, ids, k):
    held: dict[bytes, list] = {}
    parts: dict[bytes, int] = {}
    for p, v, some in zip(part.tolist(), packed, ids):
        mine = held.setdefault(v, [])
        mine += some
        if len(mine) > 8 * (k + 1):
            held[v] = sorted(mine)[: k + 1]
        parts[v] = p
    return pa.RecordBatch.from_arrays(
        [pa.array(list(parts.values()), pa.int64()), pa.array(list(parts), pa.binary()),
         pa.array([sorted(held[v])[: k + 1] for v in parts], pa.list_(pa.int64()))],
        ["part", "packed", "ids"],
    )


def _queries(batches):
    for batch in batches:
        matrix = _vectors(batch.column("v")) + 0.0
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(_fingerprints(matrix)), pa.array([r.tobytes() for r in matrix], pa.binary())],
            ["id", "part", "packed"],
        )


# --- index and search ----------------------------------------------------------------------------

def projection(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The same Gaussian matrix in every task."""
    return np.random.Generator(np.random.PCG64(5)).standard_normal((width, dimensions))


class KdTree:
    """Points in leaves of at most ``LEAF``, split at the median of the widest side."""

    def __init__(self, points: np.ndarray):
        order, self.leaves = np.arange(len(points)), []
        waiting = [order]
        while waiting:
            some = waiting.pop()
            if len(some) <= LEAF:
                self.leaves.append(some)
                continue
            own = points[some]
            side = np.ptp(own, axis=0).argmax()
            half = len(some) // 2
            cut = np.argpartition(own[:, side], half)
            waiting += [some[cut[:half]], some[cut[half:]]]
        self.order = np.concatenate(self.leaves)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in self.leaves])))
        sorted_ = points[self.order]
        self.low = np.minimum.reduceat(sorted_, self.starts[:-1])
        self.high = np.maximum.reduceat(sorted_, self.starts[:-1])

    def nearest_leaves(self, point):
        """Leaves in increasing squared distance of their boxes from the point, and the distances."""
        apart = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        distance = (apart * apart).sum(axis=1)
        by = np.argsort(distance, kind="stable")
        return by, distance[by]


def chi_square_quantile(p: float, degrees: int) -> float:
    """Smallest x whose chi-square CDF reaches p, for an even number of degrees."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def _search(entries, asked, k, confidence):
    out = ([], [], [])
    if len(entries) and len(asked):
        matrix = np.frombuffer(b"".join(entries.column("packed").to_pylist())).reshape(len(entries), -1)
        ids = entries.column("ids").to_pylist()
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        project = projection(matrix.shape[1])
        tree = KdTree((matrix / norms[:, None]) @ project)
        matrix, norms, ids = matrix[tree.order], norms[tree.order], [ids[i] for i in tree.order]
        bound = chi_square_quantile(confidence, DIMENSIONS)
        answers: dict[bytes, list] = {}
        for query_id, packed in zip(asked.column("id").to_pylist(), asked.column("packed").to_pylist()):
            if packed not in answers:
                answers[packed] = _best(np.frombuffer(packed), matrix, norms, ids, tree, project, bound, k)
            hits = [(score, i) for score, i in answers[packed] if i != query_id][:k]
            for score, i in hits:
                out[0].append(query_id)
                out[1].append(i)
                out[2].append(score)
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                     "score": pa.array(out[2], pa.float64())})


def _best(query, matrix, norms, ids, tree, project, bound, k):
    """(score, id) of the k + 1 best rows, ties to smaller ids."""
    norm = np.sqrt(query @ query)
    leaves, distances = tree.nearest_leaves((query / norm) @ project)
    best: list[tuple[float, int]] = []
    for first in range(0, len(leaves), _STEP):
        if len(best) > k:
            kth = max(0.0, 2 - 2 * best[k][0])  # squared distance of unit vectors
            if distances[first] > bound * kth + 1e-12:
                break
        some = np.concatenate([np.arange(tree.starts[i], tree.starts[i + 1]) for i in leaves[first: first + _STEP]])
        scores = (matrix[some] @ query) / (norms[some] * norm)
        if len(best) > k:
            near = np.flatnonzero(scores >= best[k][0])
        elif len(some) > k + 1:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
        else:
            near = np.arange(len(some))
        for j in near:
            best += [(float(scores[j]), i) for i in ids[some[j]]]
        best = sorted(best, key=lambda hit: (-hit[0], hit[1]))[: k + 1]
    return best
