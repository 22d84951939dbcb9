"""Packing of documents into token sequences by vector best-fit.

A document is its token ids and an end id. Documents longer than a sequence are cut into full pieces,
of which only the first may be shorter. Full pieces are sequences of their own. The others are dealt
by hash into groups of about ``GROUP`` pieces, and each group is packed by best-fit decreasing over a
vector of capacities: tokens, documents, and attention cost (the sum of squared lengths). A piece
goes to the open sequence that has room in every capacity and the best score: the largest weighted
dot-product of demand and residual, or the smallest weighted norm of the residual left behind. A
group leaves at most a few sequences open, a share of about 1 / GROUP.

No document spans groups and no token is shuffled: packing sees lengths only.

Defined cases: a null text is empty (one end id); equal documents, also of equal or null ids, are
packed one by one.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.llm.bpe import worker_tokens
from bidstream.llm.tables import ship, stored

SEQUENCE = 1024
GROUP = 8192
END = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END, documents: int | None = None,
           attention: int | None = None, weights=(1.0, 0.0, 0.0), rule: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    ``documents`` and ``attention`` bound a sequence besides its tokens; left out they never bind, and
    with the default weights only tokens choose the sequence.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    ship(docs.sparkSession)
    capacity = (sequence, documents or sequence, attention or sequence * sequence)
    if capacity[2] < sequence * sequence:
        raise ValueError("attention must have room for one full piece")
    # Tokenised once; the pieces are small and grouped by their own number.
    pieces = stored(
        docs.select("doc_id", "text").mapInArrow(partial(_pieces, tokenizer=tokenizer, sequence=sequence, end=end), _PIECES),
        "pieces",
    )
    groups = -(-pieces.where(F.col("length") < sequence).count() // GROUP) or 1
    rest = pieces.where(F.col("length") < sequence).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "ids_crc32", "row"), F.lit(groups)))
    placed = rest.groupBy("group").applyInPandas(
        partial(_placed, capacity=capacity, weights=weights, rule=rule),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    # Even numbers for full pieces, odd ones for packed sequences.
    full = pieces.where(F.col("length") == sequence).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return full.unionByName(placed)


def _pieces(batches, tokenizer, sequence, end):
    tokens = worker_tokens(tokenizer)
    last = np.array([end], "<u4").tobytes()
    row = 0
    for batch in batches:
        out = []
        ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
        for doc_id, text in zip(ids, batch.column("text").to_pylist()):
            data = tokens.ids(text or "").tobytes() + last
            count, start, row = len(data) // 4, 0, row + 1
            size = count % sequence or sequence
            piece = 0
            while start < count:
                out.append((doc_id, piece, start, size, zlib.crc32(data[4 * start: 4 * (start + size)]), row))
                start, size, piece = start + size, sequence, piece + 1
        if not out:
            continue
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 4))],
            ["doc_id", "piece", "start", "length", "ids_crc32", "row"],
        )


def _placed(rows: pd.DataFrame, capacity, weights, rule) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
    lengths = rows["length"].to_numpy()
    bins = best_fit(lengths, capacity, weights, rule)
    rows = rows.assign(sequence_id=(rows["group"].to_numpy() * 2 * (1 << 20) + 2 * bins + 1).astype(np.int64))
    rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def best_fit(lengths: np.ndarray, capacity, weights=(1.0, 0.0, 0.0), rule: str = "norm") -> np.ndarray:
    """Sequence number of each piece; the pieces come in decreasing length."""
    full = np.asarray(capacity, float)
    weights = np.asarray(weights, float)
    residual = np.empty((len(lengths), 3))
    names = np.empty(len(lengths), np.int64)
    out = np.empty(len(lengths), np.int64)
    opened = made = 0
    smallest = lengths.min() if len(lengths) else 0
    for i, length in enumerate(lengths):
        demand = np.array([length, 1.0, float(length) * length])
        left = residual[:opened] - demand
        fits = (left >= 0).all(axis=1)
        if fits.any():
            share = (left if rule == "norm" else residual[:opened] * demand / full) / full
            score = (share * share) @ weights if rule == "norm" else -(share @ weights)
            k = int(np.where(fits, score, np.inf).argmin())
            residual[k] = left[k]
        else:
            k = opened
            residual[k], names[k] = full - demand, made
            opened, made = opened + 1, made + 1
        out[i] = names[k]
        if residual[k, 0] < smallest or residual[k, 1] < 1 or residual[k, 2] < smallest * smallest:
            opened -= 1  # nothing fits any more
            residual[k], names[k] = residual[opened], names[opened]
    return out
