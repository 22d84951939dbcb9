"""Deleted interpolation: counts and base score by brute force, a proper and useful model."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidstream.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def brute(docs):
    """(id, text, held_out) in; id -> (n_tokens, n_known, train_tokens, base_score) out."""
    counts = collections.Counter(t for _, text, held in docs if not held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc_id, text, _ in docs:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out[doc_id] = (len(own), sum(counts[t] > 0 for t in own), n, pytest.approx(base, abs=1e-6))
    return out


def scored(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string, flag boolean")
    return {r.doc_id: r for r in lm.scores(frame, F.col("flag")).collect()}


def test_given_documents_equal_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    flag = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    docs = [tuple(r) for r in frame.select("doc_id", "text", flag).collect()]
    rows = {r.doc_id: r for r in lm.scores(frame, flag).collect()}
    assert {k: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for k, r in rows.items()} == brute(docs)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows.values())
    held = [r for r in rows.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_word_order_matters_and_edges(spark):
    docs = [(i, "the cat sat on the mat and the dog ran", False) for i in range(40)]
    docs += [(100, "the cat sat on the mat", True), (101, "mat the on sat cat the", True), (102, None, None),
             (103, "  \t\n", True), (104, "Éa É\x0ba", True), (None, "THE cat", True), (100, "the cat sat on the mat", True)]
    rows = scored(spark, docs)
    assert rows[100].score > rows[101].score
    assert rows[102].n_tokens == rows[103].n_tokens == 1 and not rows[102].held_out
    assert rows[104].n_tokens == 4 and rows[104].n_known == 1
    assert rows[None].n_known == 3
    assert len(lm.scores(spark.createDataFrame(docs, "doc_id long, text string, flag boolean"), F.col("flag")).collect()) == len(docs)


def test_without_training_rows_and_without_rows(spark):
    assert scored(spark, [(1, "a b", True)])[1].train_tokens == 0
    assert scored(spark, []) == {}


def test_seen_continuations_beat_unseen_ones(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(list("abcd"), 30)), False) for i in range(50)]
    docs += [(1000 + i, f"a {x}", True) for i, x in enumerate("abcd")] + [(2001, "a zz", True)]
    rows = scored(spark, docs)
    assert all(rows[1000 + i].score > rows[2001].score for i in range(4))


def test_weights_are_a_distribution():
    import pyarrow as pa

    cells = [(3, 256, 262, 50, 0), (3, 0, 262, 50, 0), (0, 0, 0, 5, 0), (-1, 0, 0, 1000, 100)]
    batch = pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells]) for i in range(5)],
                                       ["bucket", "bigram", "word", "n", "types"])
    (out,) = lm._learned([batch])
    weights = np.frombuffer(out.column("totals")[0].as_py()).reshape(lm.BUCKETS, 3)
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all() and weights[0, 0] < 1e-9
    assert weights[3, 0] > 0.3
