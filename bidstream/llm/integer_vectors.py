"""Vectors as rows of integers: usable rows of a table, floors of scaled components, packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = 256
LARGEST = 1 << 24  # floors beyond are out of reach of the exact sums of these operators


def usable(rows: DataFrame, vector: str = "v") -> tuple[DataFrame, int]:
    """Rows whose vector can take part, and the common width of their vectors (0: none).

    A vector that is null, empty or has null or non-finite components does not; nor do those of another
    width than most (the wider of equally many), or with a floor beyond ``LARGEST``.
    """
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * FACTOR < LARGEST))
    rows = rows.where(good)
    widths = rows.groupBy(F.size(v).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths["width"] if widths else 0
    return rows.where(F.size(v) == width), width


def floors(vector: str | Column = "v") -> Column:
    """floor(``FACTOR`` * x) of each component of an array of doubles."""
    return F.transform(vector, lambda x: F.floor(x * FACTOR).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow column of integer lists, without nulls, as int64."""
    values = column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    return values.astype(np.int64).reshape(-1, width)


def packed(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows, np.int32)]


def unpacked(values, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int32).reshape(-1, width).astype(np.int64)
