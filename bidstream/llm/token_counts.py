"""Token counts of whole texts by a map-side lookup in two tiers.

A compact table of the lengths of frequent pre-tokens (words, each with the space before it) is
broadcast: the ``FREQUENT`` most frequent ones of all whole texts. Each task sums its pre-tokens in a
summary of at most ``SUMMARY`` counters: when it is full, all counters lose the median and the empty ones go
(Misra and Gries), so what a task drops is rarer in it than its rows divided by half the counters. The
summaries are added up by an aggregate, from which only ``FREQUENT`` words of each of a fixed number of
buckets reach the driver. What the table lacks is encoded once per worker and cached there up to a bound.
Counts do not depend on either tier, and neither texts nor pre-tokens are shuffled.

Defined cases: a null text is empty and has no tokens; strings of special tokens inside a text are
special tokens, as the library's default has it.
"""

from __future__ import annotations

import collections
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidstream.llm.bpe import Lengths, Tokens, words, worker_lengths
from bidstream.llm.tables import ship, smallest

FREQUENT = 20_000
SUMMARY = 40_000
_WORD_BYTES = 64  # longer pre-tokens are left to the caches


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    spark = docs.sparkSession
    ship(spark)
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer))
    counted = docs.select("doc_id", "text").mapInArrow(
        partial(_counted, tokenizer=tokenizer, frequent=frequent), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def frequent_lengths(docs: DataFrame, tokenizer: str) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of all texts."""
    summaries = docs.select("text").mapInArrow(_summary, "word string, often long")
    total = summaries.groupBy("word").agg(F.sum("often").alias("often"))
    found = smallest(total, [F.desc("often"), F.col("word")], FREQUENT, buckets=4)
    lengths = Lengths(Tokens(tokenizer), {})
    return {r.word: lengths[r.word] for r in found}


def _summary(batches):
    """Counts of the frequent pre-tokens of a task."""
    held = collections.Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            held.update(words(text or "")[1:])
            if len(held) > SUMMARY:
                held = shrunk(held)
    found = [(w, n) for w, n in held.items() if len(w) <= _WORD_BYTES]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "often"])


def shrunk(held, counters=None):
    """At most half as many counters as ``counters``: all lose what the one in that place holds."""
    half = (counters or SUMMARY) // 2
    loss = sorted(held.values(), reverse=True)[half]
    return collections.Counter({w: n - loss for w, n in held.items() if n > loss})


def _counted(batches, tokenizer, frequent):
    lengths = worker_lengths(tokenizer, frequent.value)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = [lengths.of(t) for t in texts]
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )
