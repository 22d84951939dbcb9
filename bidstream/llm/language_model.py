"""Bigram language model by deleted interpolation, learned and applied where the texts lie.

The probability of a token w after u is

    lambda2(b) * c(u w) / c(u)  +  lambda1(b) * c(w) / N  +  lambda0(b) / (V + 1)

with maximum-likelihood estimates from all training tokens and weights that depend on the bucket b of
the context frequency c(u), one bucket per power of two. The weights are learned by expectation-
maximisation on held-out counts: each block of documents is deleted from the counts in turn, and its
own training tokens are predicted from the rest.

No vocabulary or n-gram table is ever held in one place, and no token is shuffled with its position.

1. Each block of documents sends its distinct words and bigrams, as fingerprints with training
   counts, in one sorted and delta-coded piece per fingerprint range.
2. The task of a range adds the counts up and answers each piece with the totals, in its order.
3. Blocks turn totals less own counts into a histogram of (bucket, bigram estimate, word count) on a
   logarithmic grid of bounded size; expectation-maximisation runs on the grid's sums.
4. Blocks score their texts from the totals and the learned weights.

Defined cases: a null text is empty and consists of the end token. A null ``held_out`` counts as
false. Without training tokens all weight is on lambda0. Fingerprints have 64 bits.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.llm.tables import blocked, ship
from bidstream.llm.texts import mixed, slices

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BUCKETS = 64
BLOCK_BYTES = 6 << 20  # of text; a task holds the distinct words and bigrams of a block
GRID = 2  # steps per octave of the histogram
ROUNDS = 200

_PIECE = "range int, kind int, block int, fingerprints binary, counts binary"
_NOTE = "block int, kind int, range int, totals binary, tokens long, types long"
_CELL = "bucket int, bigram int, word int, n long, types long"
WORD, BIGRAM, TOTAL, WEIGHTS = 0, 1, 2, 3


def scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    ship(docs.sparkSession)
    rows, count = blocked(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), BLOCK_BYTES)
    by_block = rows.groupBy("block")
    pieces = by_block.applyInArrow(partial(_pieces, ranges=count), _PIECE)
    totals = pieces.groupBy("range").applyInArrow(partial(_totals, blocks=count), _NOTE)
    cells = (
        by_block.cogroup(totals.groupBy("block")).applyInArrow(_histogram, _CELL)
        .groupBy("bucket", "bigram", "word").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    )
    # The grid is bounded, so one task can hold it; its result is one row of weights.
    learned = cells.coalesce(1).mapInArrow(_learned, "totals binary, tokens long, types long")
    weights = learned.select(
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.lit(WEIGHTS).alias("kind"),
        F.lit(0).alias("range"), "totals", "tokens", "types",
    )
    return by_block.cogroup(totals.unionByName(weights).groupBy("block")).applyInArrow(
        _scores,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


class _Block:
    """Tokens of a block: distinct words and bigrams, where each occurs, and training counts."""

    def __init__(self, docs):
        train = ~np.array(docs.column("rest").combine_chunks().field("held_out").to_numpy(zero_copy_only=False), bool)
        words, bigrams, rows = [], [], []
        for part in slices(docs.column("data")):
            low = part.lower()
            starts, ends, row = low.words()
            h = low.span_hashes(starts, ends)
            # One end token per text, placed after the text's last word.
            n = len(part)
            places = np.searchsorted(row, np.arange(n), "right")
            h, row = np.insert(h, places, END), np.insert(row, places, np.arange(n))
            before = np.roll(h, 1)
            before[np.append(0, np.flatnonzero(np.diff(row)) + 1)] = BEGIN
            words.append(h)
            bigrams.append(mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + h * np.uint64(0x9FB21C651E98DF25)))
            rows.append(row + part.first_row)
        self.row = np.concatenate(rows)
        self.train = train[self.row]
        self.types, self.at, self.own = [], [], []
        for values in (words, bigrams):
            types, at = np.unique(np.concatenate(values), return_inverse=True)
            self.types.append(types)
            self.at.append(at)
            self.own.append(np.bincount(at[self.train], minlength=len(types)))
        self.first = np.append(True, np.diff(self.row) != 0)

    def answers(self, notes):
        """Corpus counts of the distinct words and bigrams."""
        kinds, ranges, blobs = (notes.column(c).to_pylist() for c in ("kind", "range", "totals"))
        found = []
        for kind in (WORD, BIGRAM):
            blocks = sorted((r, b) for k, r, b in zip(kinds, ranges, blobs) if k == kind)
            found.append(np.concatenate([_unplaned(b) for _, b in blocks]).astype(np.int64))
        return found

    def context(self, word_counts):
        """Count of the token before each token; as often as texts begin, they end."""
        end = word_counts[np.searchsorted(self.types[WORD], END)]
        per_token = word_counts[self.at[WORD]]
        before = np.roll(per_token, 1)
        before[self.first] = end
        return per_token, before


def _planed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compresses well for small numbers."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def _pieces(docs, ranges):
    block = _Block(docs)
    name = docs.column("block")[0].as_py()
    out = []
    for kind in (WORD, BIGRAM):
        types, counts = block.types[kind], block.own[kind].astype(np.uint64)
        place = ((types >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        edges = np.append(np.flatnonzero(np.append(True, np.diff(place) != 0)), len(types))
        for a, b in zip(edges[:-1], edges[1:]):
            deltas = np.diff(types[a:b], prepend=np.uint64(0))
            out.append((int(place[a]), kind, name, _planed(deltas), _planed(counts[a:b])))
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
        ["range", "kind", "block", "fingerprints", "counts"],
    )


def _totals(pieces, blocks):
    name = pieces.column("range")[0].as_py()
    out, tokens, types = [], 0, 0
    for kind in (WORD, BIGRAM):
        some = pieces.filter(pa.compute.equal(pieces.column("kind"), kind))
        if not len(some):
            continue
        held = [np.cumsum(_unplaned(b), dtype=np.uint64) for b in some.column("fingerprints").to_pylist()]
        sizes = [len(h) for h in held]
        _, at = np.unique(np.concatenate(held), return_inverse=True)
        counts = np.concatenate([_unplaned(b) for b in some.column("counts").to_pylist()]).astype(np.int64)
        sums = np.bincount(at, weights=counts).astype(np.uint64)
        if kind == WORD:
            tokens, types = int(sums.sum()), int(np.count_nonzero(sums))
        for block, answer in zip(some.column("block").to_pylist(), np.split(sums[at], np.cumsum(sizes)[:-1])):
            out.append((block, kind, name, _planed(answer), 0, 0))
    # The corpus totals travel through any one block that exists.
    out.append((pieces.column("block")[0].as_py(), TOTAL, name, None, tokens, types))
    return _notes(out)


def _notes(rows):
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                ["block", "kind", "range", "totals", "tokens", "types"])


def _log2_cell(values):
    """0 for zero, else a cell of the logarithmic grid (never 0)."""
    out = np.zeros(len(values), np.int64)
    positive = values > 0
    out[positive] = np.round(GRID * np.log2(values[positive])).astype(np.int64) + 256
    return out


def _bucket(context):
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _histogram(docs, notes):
    """Cells of held-out training tokens; bucket -1 carries the corpus totals."""
    rows = []
    if len(docs):
        block = _Block(docs)
        rest = [total - own for total, own in zip(block.answers(notes), block.own)]
        word, context = block.context(rest[WORD])
        bigram = rest[BIGRAM][block.at[BIGRAM]]
        t = block.train
        estimate = bigram[t] / np.maximum(context[t], 1)
        cells = np.stack([_bucket(context[t]), _log2_cell(estimate), _log2_cell(word[t].astype(float))], axis=1)
        cells, n = np.unique(cells, axis=0, return_counts=True)
        rows = [(*c, k, 0) for c, k in zip(cells.tolist(), n.tolist())]
    for kind, tokens, types in zip(*(notes.column(c).to_pylist() for c in ("kind", "tokens", "types"))):
        if kind == TOTAL:
            rows.append((-1, 0, 0, tokens, types))
    return pa.Table.from_arrays(
        [pa.array([r[i] for r in rows], pa.int32() if i < 3 else pa.int64()) for i in range(5)],
        ["bucket", "bigram", "word", "n", "types"],
    )


def _learned(batches):
    """Mixture weights (bucket by bigram, word, uniform) by expectation-maximisation on the grid."""
    columns = [[b.column(i).to_numpy().astype(np.int64) for i in range(5)] for b in batches]
    if not columns:
        return
    bucket, bigram, word, n, types = (np.concatenate(c) for c in zip(*columns))
    total = bucket < 0
    tokens, vocabulary = int(n[total].sum()), int(types[total].sum())
    value = lambda cell: np.where(cell > 0, np.exp2((cell - 256) / GRID), 0.0)
    weights = np.full((BUCKETS, 3), np.nan)
    for b in range(BUCKETS):
        some = bucket == b
        if not some.any():
            continue
        p = np.stack([np.minimum(value(bigram[some]), 1), np.minimum(value(word[some]) / max(tokens, 1), 1),
                      np.full(some.sum(), 1 / (vocabulary + 1))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p * w
            share *= (n[some] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) + [0, 0, 0.5]  # unseen words keep some probability
            w /= w.sum()
        weights[b] = w
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    for b in range(BUCKETS):  # buckets without held-out tokens take the nearest one's
        weights[b] = weights[known[np.argmin(np.abs(known - b))]] if len(known) else (0, 0, 1)
    if 0 not in known:
        weights[0] = (0, *weights[0][1:]) if weights[0][1:].sum() > 0 else (0, 0, 1)
        weights[0] /= weights[0].sum()
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights.tobytes()], pa.binary()), pa.array([tokens], pa.int64()), pa.array([vocabulary], pa.int64())],
        ["totals", "tokens", "types"],
    )


def _scores(docs, notes):
    n = len(docs)
    tokens = 0
    counts, known, base, score = (np.zeros(n) for _ in range(4))
    if n:
        block = _Block(docs)
        totals = block.answers(notes)
        learned = notes.filter(pa.compute.equal(notes.column("kind"), WEIGHTS))
        weights = np.frombuffer(learned.column("totals")[0].as_py()).reshape(BUCKETS, 3)
        tokens, vocabulary = learned.column("tokens")[0].as_py(), learned.column("types")[0].as_py()
        word, context = block.context(totals[WORD])
        bigram = totals[BIGRAM][block.at[BIGRAM]]
        w = weights[_bucket(context)]
        p = w[:, 0] * bigram / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (vocabulary + 1)
        per_row = lambda values: np.bincount(block.row, weights=values, minlength=n)
        counts, known = per_row(np.ones(len(word))), per_row(word > 0)
        base = per_row(np.log10((word + 0.5) / (tokens + 0.5 * (vocabulary + 1))))
        score = per_row(np.log10(p))
    rest = docs.column("rest").combine_chunks()
    rest = rest if isinstance(rest, pa.StructArray) else rest.chunk(0) if rest.num_chunks else None
    field = lambda name, kind: rest.field(name).cast(kind) if rest is not None else pa.array([], kind)
    return pa.table({
        "doc_id": field("doc_id", pa.int64()), "held_out": field("held_out", pa.bool_()),
        "n_tokens": pa.array(counts.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
        "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score),
    })
