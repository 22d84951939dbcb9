"""Suffix-array deduplication against brute force over all strings."""

import hashlib
import random

import numpy as np
import pytest

from bidstream.llm.suffix_dedup import remove_repeats, suffix_order, without_repeats

LENGTH = 100
COLUMNS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(docs):
    """(id, text) rows in, one tuple of COLUMNS per row out; ids are distinct."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - LENGTH + 1):
            piece = data[i: i + LENGTH]
            if piece in seen:
                gone[i: i + LENGTH] = [True] * LENGTH
            seen.add(piece)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def got(frame):
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def _corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(40) for _ in range(6)]
    docs = []
    for i in range(120):
        body = [prose(rng.randint(1, 40)) for _ in range(3)]
        body.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 30):])
        docs.append((i * 7, " ".join(body)))
    docs += [(5001 + i, passages[0] + prose(3)) for i in range(60)]  # hot passage
    docs += [(6001, "ab" * 400), (6002, "a" * 700), (6003, "b" * 99), (6004, "a" * 100), (6005, ""), (6006, None)]
    docs += [(6007, docs[0][1]), (6008, docs[0][1]), (6009, (passages[1] + " ") * 5), (None, passages[2])]
    docs += [(-3, "x" + passages[3])]
    return docs


def test_equals_brute_force(spark):
    docs = _corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(remove_repeats(frame)) == brute(docs)


def test_given_documents_equal_brute_force(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    assert got(remove_repeats(frame)) == brute(docs)


def test_order_equals_plain_sort():
    rng = np.random.default_rng(1)
    strings = rng.integers(0, 3, (500, 64), dtype=np.uint8)
    strings[200:400, :50] = 1  # long common prefixes reach the tries
    strings[300:350] = strings[200]
    group = rng.integers(0, 4, 500)
    order = suffix_order(strings, group, shallow=16)
    have = [(group[i], strings[i].tobytes()) for i in order]
    assert have == sorted(have) and sorted(order) == list(range(500))


def test_text_stays_valid_and_other_columns_stay(spark):
    shared = " ".join(f"é{i}" for i in range(40))
    docs = [(1, shared, "k", 1), (2, "zz" + shared + "zz", None, 2)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, block string, hash int")
    rows = {r.doc_id: r for r in without_repeats(frame).collect()}
    assert rows[1].text == shared and rows[2].text == "zzzz"
    assert rows[1].block == "k" and rows[2].hash == 2


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "short"), (1, "short")]])
def test_small_tables(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(frame).collect()] == [0] * len(rows)
