"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A text is read in overlapping windows, and each window is compressed twice: after ordinary text, and
after ordinary and toxic text. The difference of the two lengths, in bytes, is what toxic text explains
of the window. A document's differences (mean, shares over two and three bytes, largest, mean of the
three largest) are weighed by a logistic calibration.

Training uses a bounded sample of labelled documents (see ``samples``), lower-cased. The ordinary dictionary
is trained on ``ORDINARY_WINDOWS`` windows of ordinary documents, the toxic one on toxic documents without
the words that tell nothing: kept are words at least ``RATIO`` times rarer in ordinary documents, so much bound to
toxic ones that labels dealt at random would mark ``CHANCE`` words or fewer among all. Near copies count once. What both kinds share would only add noise to a difference of
lengths; leaving it out is a departure from dictionaries of whole texts, and the README has figures of both.

Calibration and threshold are cross-fitted: each of ``FOLDS`` parts of the sample is measured with
dictionaries of the others. The cut at 0.5 is where a share of ``FALSE`` of the ordinary documents lies above.
Everything is ordered by hashes of texts, so the same
rows in another order give the same scores. The driver gets at most ``PIECES`` pieces of ``PIECE`` bytes of a
sampled text, chosen by hash over the whole of it, and the measures of whole texts, which tasks compute.

Defined cases: null and empty texts are one empty window; without toxic or ordinary training rows
every score is the prior. Whole texts are scored.
"""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidstream.llm.logistic import fit, sigmoid
from bidstream.llm.samples import labelled
from bidstream.llm.tables import ship, stored

WINDOW, STRIDE = 64, 48
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2_048
ORDINARY_WINDOWS = 40_000
RATIO, SUPPORT = 25.0, 0.02
CHANCE = 10  # words that chance may mark
FOLDS = 5
FALSE = 0.005
PIECES, PIECE = 16, 2_048  # of each sampled text, to learn dictionaries from
_SKETCH, _ALIKE = 24, 12  # texts that share so many of their smallest word hashes are near copies
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def scores(docs: DataFrame, labels: DataFrame, held_out: Column, train: Column, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    ship(docs.sparkSession)
    model = train_model(labelled(docs, labels, label, train))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    scored = rows.mapInArrow(partial(_scored, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic") -> DataFrame:
    """Rows of ``docs`` whose score is below 0.5."""
    ship(docs.sparkSession)
    model = train_model(labelled(docs, labels, label, train))
    return docs.mapInArrow(partial(_ordinary_rows, model=model), docs.schema)


# --- training ------------------------------------------------------------------------------------

def train_model(sample: DataFrame):
    """Dictionaries and calibration from rows of label and text; only a prior if a label is missing."""
    sample = stored(sample, "labelled")
    found = sample.mapInArrow(_pieces, "label int, key binary, piece binary").collect()
    pieces = sorted((bytes(r.key), r.label, bytes(r.piece)) for r in found)
    if len({label for _, label, _ in pieces}) < 2:
        return {"prior": float(any(label for _, label, _ in pieces))}
    sample_words = _Words(pieces)
    folds = [_dictionaries([p for p in pieces if _fold(p[0]) != fold], sample_words) for fold in range(FOLDS)]
    measured = sample.mapInArrow(partial(_measured, folds=folds), "label int, x array<double>").collect()
    return calibrated(_dictionaries(pieces, sample_words), sorted((tuple(r.x), r.label) for r in measured))


def calibrated(model, measured):
    """``model`` with the calibration of (measures, label) of cross-fitted documents."""
    x, y = np.array([m for m, _ in measured]), np.array([float(label) for _, label in measured])
    curve = fit(x, y)
    values = curve(x)
    curve.bias -= float(np.quantile(values[y == 0], 1 - FALSE, method="higher")) + 1e-6
    return model | {"calibration": curve}


def _key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def _fold(key: bytes) -> int:
    return key[0] % FOLDS


def _pieces(batches):
    """Pieces of each text, cut at spaces; of a long one those of the smallest hashes."""
    for batch in batches:
        out = []
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            data = _lowered(text)
            cuts = [0]
            while cuts[-1] < len(data):
                end = cuts[-1] + PIECE
                space = data.rfind(b" ", cuts[-1] + 1, end) if end < len(data) else -1
                cuts.append(min(space if space > 0 else end, len(data)))
            some = [data[a:b] for a, b in zip(cuts, cuts[1:])] or [b""]
            if len(some) > PIECES:
                some = sorted(some, key=_key)[:PIECES]
            out += [(label, _key(data), piece) for piece in some]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["label", "key", "piece"])


def _measured(batches, folds):
    """Measures of whole texts by the dictionaries that have not seen them."""
    measures = [measurer(model) for model in folds]
    for batch in batches:
        x = []
        for text in batch.column("text").to_pylist():
            data = _lowered(text)
            x.append([float(v) for v in measures[_fold(_key(data))](data)])
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])


class _Words:
    """The words of a sample as numbers: a few bytes for each word of a document on the driver."""

    def __init__(self, pieces):
        self.number, found = {}, {}
        for key, label, piece in pieces:
            mine = [self.number.setdefault(w, len(self.number)) for w in piece.split()]
            found.setdefault((key, label), []).append(np.unique(np.array(mine, np.int32)))
        self.of = {k: np.unique(np.concatenate(v)) for k, v in found.items()}
        self.hash = np.array([int.from_bytes(_key(w), "big") >> 1 for w in self.number], np.int64)

    def spread(self, documents):
        """In how many of the documents (arrays of numbers) each word is."""
        return np.bincount(np.concatenate([*documents, np.zeros(0, np.int32)]), minlength=len(self.number))


def _dictionaries(pieces, words):
    """Dictionaries of (key, label, piece), which are in order of their keys."""
    import zstandard

    documents = ({}, {})  # by label
    for key, label, _ in pieces:
        documents[label][key] = words.of[key, label]
    kept = marked(documents[1], documents[0], words)
    reduced = {}
    for key, label, piece in pieces:
        if label:
            reduced[key] = reduced.get(key, b" ") + b"".join(w + b" " for w in piece.split() if words.number[w] in kept)
    windows = heapq.nsmallest(ORDINARY_WINDOWS, {_key(w): w for _, label, piece in pieces if not label for w in _windows(piece, WINDOW)}.items())
    return {
        "ordinary": _dictionary(zstandard, [w for _, w in windows], ORDINARY_BYTES, 32),
        "toxic": _dictionary(zstandard, [r for r in reduced.values() if len(r) > 1], TOXIC_BYTES, 16),
    }


def marked(toxic, ordinary, words):
    """Numbers of the words (of documents as arrays of numbers, by key) that mark toxic documents."""
    families = _families(toxic, words)
    inside, outside = words.spread(families), words.spread(ordinary.values())
    total, rest = max(1, len(families)), max(1, len(ordinary))
    share = total / (total + rest)
    chance = math.log(max(2, np.count_nonzero(inside) / CHANCE))
    out = set()
    for word in np.flatnonzero((inside >= SUPPORT * total) & (inside / total > RATIO * (outside + 0.5) / rest)):
        n, other = int(inside[word]), int(outside[word])
        # Chernoff's bound of so many toxic ones among all documents with the word.
        surprise = n * math.log(n / (n + other) / share) + (other * math.log(other / (n + other) / (1 - share)) if other else 0)
        if surprise > chance:
            out.add(int(word))
    return out


def _families(documents, words):
    """Words of the documents, near copies together."""
    families, known = [], {}
    for key in sorted(documents):
        sketch = np.sort(words.hash[documents[key]])[:_SKETCH].tolist()
        alike = collections.Counter(known[h] for h in sketch if h in known)
        at, shared = max(alike.items(), key=lambda x: (x[1], -x[0]), default=(None, 0))
        if shared >= _ALIKE:
            families[at] = np.union1d(families[at], documents[key])
        else:
            families.append(documents[key])
            at = len(families) - 1
        known.update((h, at) for h in sketch)
    return families


def _lowered(text) -> bytes:
    return (text or "").encode().translate(_LOWER)


def _windows(data: bytes, stride: int = STRIDE):
    return [data[i: i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + stride), stride)]


def _dictionary(zstandard, samples, size, segment):
    """A trained dictionary; with too few samples to train on, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


# --- scoring -------------------------------------------------------------------------------------

def measurer(model):
    """Function from lower-cased bytes to the features of a document."""
    import zstandard

    def compressor(content):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            3, dict_size=len(content), source_size=WINDOW, min_match=5, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary).compress

    ordinary, both = compressor(model["ordinary"]), compressor(model["toxic"] + model["ordinary"])

    def measure(data: bytes):
        windows = _windows(data)
        gains = np.array([*map(len, map(ordinary, windows))]) - np.array([*map(len, map(both, windows))])
        top = np.sort(gains)[-3:]
        return gains.mean(), (gains >= 2).mean(), (gains >= 3).mean(), top[-1], top.mean()

    return measure


def _score(model):
    if "calibration" not in model:
        return lambda text: model["prior"]
    measure, calibrated = measurer(model), model["calibration"]
    return lambda text: float(sigmoid(calibrated(np.array([measure(_lowered(text))]))[0]))


def _scored(batches, model):
    score = _score(model)
    for batch in batches:
        values = [score(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(values, pa.float64())],
            ["doc_id", "held_out", "score"])


def _ordinary_rows(batches, model):
    score = _score(model)
    for batch in batches:
        keep = [score(t) < 0.5 for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))
