"""Compression of integer vectors to part codes, with per-dimension value dictionaries.

Components become integers floor(256 * x). A vector is cut into ``PARTS`` equal parts; each part position
has a codebook of ``ENTRIES`` entries, and a part's code is the index of its nearest entry.

Vectors are held in blocks of at most ``BLOCK`` rows. A block keeps, for each dimension, the dictionary of
its distinct integers and each row's index into it: components repeat a lot, so a dictionary is short.
To assign a block, the squared differences of every dictionary value to all entries of the codebook are
tabulated once per dimension; the distance of a part to all entries is then a gather from each of its
dimensions' tables, added up. The work per row has no multiplication, and no table grows with the
corpus: a block's has at most ``BLOCK`` values per dimension.

Codebooks start as the parts of the vectors of the smallest ids. Each round assigns all parts, sums them
by entry in tasks (one row per task, part and entry) and then over tasks; an entry becomes the floor of
its parts' mean. Only codebooks reach the driver: ``ENTRIES`` times the width of a vector in numbers.
The table is read and cut into blocks once, and blocks are read once per round.

Defined cases: see ``integer_vectors.usable`` for rows that are dropped. Ties go to the entry of lower
index. With fewer rows than ``ENTRIES`` codebooks have as many entries as rows. Rows of equal id start
entries in order of their vectors; a null id comes last. Repeated rows count each. Rows of null label
form a group of their own. Only the three named columns are read, so other columns cannot clash. Without
rows the result is empty. A width that ``PARTS`` does not divide is an error.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from bidstream.llm.integer_vectors import floors, matrix, usable
from bidstream.llm.tables import ship, smallest, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 4096

_SUMS = "part int, entry int, rows long, sums array<long>"


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id",
               vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each usable row."""
    spark = vectors.sparkSession
    ship(spark)
    kinds = [StructField("id", vectors.schema[id_column].dataType), StructField("label", vectors.schema[label].dataType)]
    rows, width = usable(vectors.select(
        F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")))
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = rows.select("id", "label", floors().alias("v"))
    block = StructType()
    for kind in kinds:
        block = block.add(f"{kind.name}s", ArrayType(kind.dataType))
    for name, kind in (("sizes", ArrayType(IntegerType())), ("values", ArrayType(IntegerType())), ("codes", BinaryType())):
        block = block.add(name, kind)
    blocks = stored(rows.mapInArrow(partial(_blocks, width=width), block), "vector-blocks")
    books = first_books(rows, entries, width)
    for _ in range(rounds if len(books) else 0):
        sums = blocks.mapInArrow(partial(_entry_sums, books=books, parts=parts), _SUMS)
        total = sums.groupBy("part", "entry").agg(
            F.sum("rows").alias("rows"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width // parts)])
        books = moved(books, total.collect(), parts)
    out = StructType(kinds).add("code", "string").add("error", "long")
    done = stored(blocks.mapInArrow(partial(_coded, books=books, parts=parts), out), "vector-codes")
    by_label = done.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return done.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias(id_column), F.col("label").alias(label), "code", "error", "label_error",
        F.lit(digest(books, parts)).alias("codebooks_sha256"))


def first_books(rows: DataFrame, entries: int, width: int) -> np.ndarray:
    """Integers of the rows of smallest ids, one row each."""
    few = smallest(rows.select("id", "v"), [F.col("id").asc_nulls_last(), F.col("v")], entries)
    return np.array([r.v for r in few], np.int64).reshape(len(few), width)


def moved(books, total, parts):
    """Codebooks after a round: entries with parts become the floor of their mean."""
    books, size = books.copy(), books.shape[1] // parts
    for r in total:  # at most a row per part and entry
        a = r.part * size
        books[r.entry, a: a + size] = [r[f"s{i}"] // r.rows for i in range(size)]
    return books


def digest(books, parts) -> str:
    """sha256 of all components by part, entry and place, comma-joined."""
    by_part = books.reshape(len(books), parts, books.shape[1] // parts).transpose(1, 0, 2)
    return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()


# --- blocks --------------------------------------------------------------------------------------

def _blocks(batches, width):
    """One row per block: ids, labels, the sizes and values of the dictionaries, and the codes by dimension."""
    for batch in batches:
        for first in range(0, len(batch), BLOCK):
            some = batch.slice(first, BLOCK)
            rows = matrix(some.column("v"), width)
            found = [np.unique(column, return_inverse=True) for column in rows.T]
            sizes = np.array([len(values) for values, _ in found])
            codes = np.stack([index.ravel() for _, index in found]).astype(_kind(sizes))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, len(some)], some.column(c)) for c in ("id", "label")]
                + [pa.array([sizes], pa.list_(pa.int32())), pa.array([np.concatenate([v for v, _ in found])], pa.list_(pa.int32())),
                   pa.array([codes.tobytes()], pa.binary())],
                ["ids", "labels", "sizes", "values", "codes"])


def _kind(sizes):
    return np.uint8 if max(sizes) <= 256 else np.uint16


def _read(batch):
    """For each block its row in the batch, dictionaries and codes."""
    for i in range(len(batch)):
        sizes = batch.column("sizes")[i].as_py()
        values = batch.column("values")[i].values.to_numpy().astype(np.int64)
        codes = np.frombuffer(batch.column("codes")[i].as_py(), _kind(sizes)).reshape(len(sizes), -1)
        yield i, np.split(values, np.cumsum(sizes)[:-1]), codes


def assigned(dictionaries, codes, books, parts):
    """Nearest entry of each part, and its squared distance: arrays of parts by rows."""
    size = len(dictionaries) // parts
    entry = np.zeros((parts, codes.shape[1]), np.int64)
    least = np.zeros_like(entry)
    reach = max((max(abs(int(v[0])), abs(int(v[-1]))) for v in dictionaries), default=0) + np.abs(books).max(initial=0)
    kind = np.int32 if size * reach ** 2 < 1 << 31 else np.int64
    for part in range(parts):
        distance = 0
        for d in range(part * size, part * size + size):
            table = ((dictionaries[d][:, None] - books[:, d]) ** 2).astype(kind)
            distance = distance + table[codes[d]]
        entry[part] = distance.argmin(axis=1)  # the first of equals
        least[part] = distance[np.arange(len(distance)), entry[part]]
    return entry, least


def _entry_sums(batches, books, parts):
    """Rows and sums of the parts of each entry, over all blocks of a task."""
    entries, width = books.shape
    size = width // parts
    rows = np.zeros((parts, entries), np.int64)
    sums = np.zeros((parts, entries, size), np.int64)
    for batch in batches:
        for _, dictionaries, codes in _read(batch):
            entry, _ = assigned(dictionaries, codes, books, parts)
            for part in range(parts):
                rows[part] += np.bincount(entry[part], minlength=entries)
                for j in range(size):
                    values = dictionaries[part * size + j]
                    # How often each value goes with each entry, times the values.
                    often = np.bincount(entry[part] * len(values) + codes[part * size + j], minlength=entries * len(values))
                    sums[part, :, j] += often.reshape(entries, -1) @ values
    part, entry = np.nonzero(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(rows[part, entry], pa.int64()),
         pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
        ["part", "entry", "rows", "sums"])


def _coded(batches, books, parts):
    digits = np.array([f"{i:02x}" for i in range(max(1, len(books)))])
    for batch in batches:
        for i, dictionaries, codes in _read(batch):
            entry, least = assigned(dictionaries, codes, books, parts)
            code = digits[entry[0]]
            for part in range(1, parts):
                code = np.char.add(code, digits[entry[part]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(code, pa.string()),
                 pa.array(least.sum(axis=0), pa.int64())],
                ["id", "label", "code", "error"])
