"""Suffix-array deduplication of byte strings, with deep-shallow sorting.

A byte is removed when it is covered by a string of ``length`` bytes that also starts earlier: in a
document of smaller doc_id, or earlier in the same document. Overlapping occurrences count, matches
never cross documents and every string is judged on the input.

Sorting all suffixes of a corpus is not needed to find equal strings of a fixed length. Every such
string holds one *anchor*: the ``SEED`` bytes with the smallest fingerprint in it, the leftmost of
equals. Equal strings have equal anchors at equal places, so only anchors seen twice matter:

1. Each block of documents names its distinct anchors (block, fingerprint): a passage that fills a
   third of the corpus gives one row per block, not one per copy.
2. Fingerprints seen twice go back to the blocks that have them.
3. Blocks send the surroundings of those anchors, equal surroundings once, with the first place.
4. Per fingerprint the strings from the anchor onwards, and those before it read backwards, are put
   in suffix order: multikey quicksort to a shallow depth on eight-byte characters, then a blind
   trie for each group that still shares its prefix. Longest common prefixes of neighbours then give,
   for every offset, the classes of equal strings, and the earliest member of each is kept.
5. Blocks remove what repeated anchors cover, but for the strings kept in step 4.

All steps are one plan, in which the shuffle of the texts into blocks is written once and read three
times. What is shuffled besides is a few per cent of the bytes, in rows that no key can pile up.

Defined cases: null text is empty. Null doc_id counts as the largest id. Rows of equal doc_id come
in order of a hash of their texts; wholly equal rows are one document and do not match each other.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from bidstream.llm.tables import blocked, ship
from bidstream.llm.texts import slices

LENGTH = 100
SEED = 24
SHALLOW = 32

_ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
_SIGHTING = "hash long, block int, many boolean"
_PLACE = "hash long, block int, doc long, th long, at int, before int, context binary"
_JUDGED = "block int, hash long, doc long, th long, at int, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept_text (binary) instead of the text; columns of
    these names are replaced."""
    if length < 2 * SEED:
        raise ValueError(f"length must be at least {2 * SEED}")
    spark = docs.sparkSession
    ship(spark)
    rows, count = blocked(docs)
    by_block = rows.groupBy("block")
    seen = rows.mapInArrow(partial(_sightings, length=length), _SIGHTING)
    repeated = seen.repartition(count, "hash").mapInArrow(_repeated, "block int, hash long")
    places = by_block.cogroup(repeated.groupBy("block")).applyInArrow(partial(_places, length=length), _PLACE)
    judged = places.repartition(count, "hash").mapInArrow(partial(_judged, length=length), _JUDGED)
    out = StructType([StructField("rest", rows.schema["rest"].dataType)])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept_text", "binary")):
        out = out.add(name, kind)
    done = by_block.cogroup(judged.groupBy("block")).applyInArrow(partial(_cleaned, length=length), out)
    return done.select(*[F.col(f"rest.`{c}`") for c in docs.columns if c.lower() not in (*_ADDED, "text")], *_ADDED)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with their repeated strings cut out of the text; a character stays if any of its
    bytes does not repeat, so the text stays valid. A column n_chars follows the text; null stays null."""
    # The columns travel as one struct, so none of them can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    done = remove_repeats(docs.select("doc_id", "text", row, F.col("text").isNotNull().alias("had_text")), length)
    text = F.decode("kept_text", "UTF-8")
    new = {"text": F.when(F.col("had_text"), text), "n_chars": F.when(F.col("had_text"), F.length(text).cast("long"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


# --- anchors -------------------------------------------------------------------------------------

class _Runs:
    """Runs of string starts that share an anchor: row, anchor place, first and last start."""

    def __init__(self, part, length):
        self.hash = np.zeros(0, np.uint64)
        self.row = self.at = self.first = self.last = np.zeros(0, np.int64)
        n = len(part.data)
        if n < length:
            return
        grams = np.arange(n - SEED + 1)
        h = part.span_hashes(grams, grams + SEED)
        # High half: order of the fingerprint; low half: place, so that a minimum is leftmost.
        low = (h & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
        width, step = length - SEED + 1, 1
        out = len(low) - width + 1
        while 2 * step <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:out], low[width - step: width - step + out])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.repeat(np.arange(len(part)), np.diff(part.offsets))[:out]
        fits = np.arange(out) + length <= part.offsets[row + 1]
        change = np.ones(out, bool)
        change[1:] = (at[1:] != at[:-1]) | ~fits[:-1]
        first = np.flatnonzero(change & fits)
        if not len(first):
            return
        stop = np.zeros(out, bool)
        stop[:-1] = change[1:] | ~fits[1:]
        stop[-1] = True
        self.first, self.last = first, np.flatnonzero(stop & fits)
        self.row, self.at = row[first], at[first]
        self.hash = h[self.at]


def _distinct(parts_of_hashes):
    """Distinct fingerprints and whether each occurs more than once."""
    if not parts_of_hashes:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    values, counts = np.unique(np.concatenate(parts_of_hashes), return_counts=True)
    return values, counts > 1


def _sightings(batches, length):
    seen: dict[int, list] = {}
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        for part in slices(batch.column("data")):
            runs = _Runs(part, length)
            block = blocks[part.first_row + runs.row]
            for b in np.unique(block):
                values = runs.hash[block == b]
                held = seen.setdefault(int(b), [])
                held.append(values)
    for b, held in seen.items():
        values, many = _distinct(held)
        for i in range(0, len(values), 1 << 17):
            v = values[i: i + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.view(np.int64)), pa.array(np.full(len(v), b, np.int32)), pa.array(many[i: i + (1 << 17)])],
                ["hash", "block", "many"],
            )


def _repeated(batches):
    columns = [(b.column("hash").to_numpy(), b.column("block").to_numpy(), b.column("many").to_numpy(zero_copy_only=False))
               for b in batches]
    if not columns:
        return
    h, block, many = (np.concatenate(c) for c in zip(*columns))
    order = np.argsort(h, kind="stable")
    h, block, many = h[order], block[order], many[order]
    same = h[1:] == h[:-1]
    many[1:] |= same
    many[:-1] |= same
    yield pa.RecordBatch.from_arrays([pa.array(block[many]), pa.array(h[many])], ["block", "hash"])


def _known(table):
    """Sorted fingerprints of a cogrouped side."""
    h = table.column("hash").drop_null().to_numpy().view(np.uint64)
    return np.unique(h)


def _among(values, known):
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _rows_of(docs):
    return docs.column("doc").to_numpy(), docs.column("th").to_numpy()


def _places(docs, repeated, length):
    """Surroundings of repeated anchors, equal ones once per block with their first place."""
    found: dict[tuple, tuple] = {}
    if len(docs) and len(repeated):
        known, block = _known(repeated), docs.column("block")[0].as_py()
        doc, th = _rows_of(docs)
        for part in slices(docs.column("data")):
            runs = _Runs(part, length)
            text = part.data.tobytes()
            for i in np.flatnonzero(_among(runs.hash, known)):
                row, at, first = runs.row[i], int(runs.at[i]), int(runs.first[i])
                key = (int(runs.hash[i].view(np.int64)), at - first, text[first: int(runs.last[i]) + length])
                place = (int(doc[part.first_row + row]), int(th[part.first_row + row]), at - int(part.offsets[row]))
                if key not in found or place < found[key]:
                    found[key] = place
    h, before, context = zip(*found) if found else ((), (), ())
    d, t, at = zip(*found.values()) if found else ((), (), ())
    return pa.table({
        "hash": pa.array(h, pa.int64()), "block": pa.array([block] * len(h) if found else [], pa.int32()),
        "doc": pa.array(d, pa.int64()), "th": pa.array(t, pa.int64()), "at": pa.array(at, pa.int32()),
        "before": pa.array(before, pa.int32()), "context": pa.array(context, pa.binary()),
    })


# --- deep-shallow sorting ------------------------------------------------------------------------

def suffix_order(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of zero-padded strings (rows of bytes, width a multiple of 8) by group, then bytes."""
    order = np.argsort(group, kind="stable")
    if len(order) < 2:
        return order
    characters = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    together = group[order][1:] == group[order][:-1]
    for depth in range(min(shallow, strings.shape[1]) // 8):
        part = np.concatenate(([0], np.cumsum(~together)))
        open_part = np.bincount(part)[part] > 1
        if not open_part.any():
            return order
        # Parts of one string are done; the rest is split by the next character.
        some = np.flatnonzero(open_part)
        at = order[some]
        by = np.lexsort((characters[at, depth], part[some]))
        order[some] = at[by]
        value = characters[order, depth]
        together &= value[1:] == value[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~together)))
    last = np.append(first[1:], len(order))
    for a, b in zip(first[last - first > 1], last[last - first > 1]):
        order[a:b] = _blind_trie([(strings[i].tobytes(), i) for i in order[a:b]])
    return order


def _blind_trie(pairs):
    """Indices in order of their strings, all of one width.

    A node is [depth, children by byte]; a leaf is (string, indices). A search looks only at the
    bytes where nodes branch, and compares with one leaf to find where the string leaves the trie.
    """
    width = len(pairs[0][0])
    root = (pairs[0][0], [pairs[0][1]])
    for string, index in pairs[1:]:
        node = root
        while isinstance(node, list):
            children = node[1]
            node = children.get(string[node[0]]) or next(iter(children.values()))
        if node[0] == string:
            node[1].append(index)
            continue
        difference = int.from_bytes(string, "big") ^ int.from_bytes(node[0], "big")
        common = width - (difference.bit_length() + 7) // 8
        leaf, other = (string, [index]), node[0]
        above, node = None, root
        while isinstance(node, list) and node[0] < common:
            above, node = node, node[1][string[node[0]]]
        if isinstance(node, list) and node[0] == common:
            node[1][string[common]] = leaf
            continue
        branch = [common, {string[common]: leaf, other[common]: node}]
        if above is None:
            root = branch
        else:
            above[1][string[above[0]]] = branch
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting.extend(node[1][byte] for byte in sorted(node[1], reverse=True))
        else:
            out.extend(node[1])
    return out


def _common_prefixes(strings, order, group):
    """Length of the prefix that each string of the order shares with the one before it."""
    shared = np.zeros(len(order), np.int64)
    a, b = strings[order[1:]], strings[order[:-1]]
    differs = a != b
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    shared[0] = -1
    return shared


def _padded(pieces, width):
    out = np.zeros((len(pieces), -(-width // 8) * 8), np.uint8)
    for i, piece in enumerate(pieces):
        out[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def _judged(batches, length):
    """For each place, the offsets at which its string is the first of its equals (one bit each)."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    places = pa.concat_tables(tables)
    del tables
    h, doc, th, at, before = (places.column(c).to_numpy() for c in ("hash", "doc", "th", "at", "before"))
    by_place = np.lexsort((at, th, doc))
    context = places.column("context").to_pylist()
    kept = np.zeros((len(h), length - SEED + 1), bool)
    _, sizes_at, sizes = np.unique(h, return_inverse=True, return_counts=True)
    alone = sizes[sizes_at] == 1
    after = np.array([len(c) for c in context]) - before
    offsets = np.arange(length - SEED + 1)  # how far the string starts before its anchor
    kept[alone] = (offsets <= before[alone][:, None]) & (length - offsets <= after[alone][:, None])
    some = by_place[~alone[by_place]]  # in order of place
    step = 1 << 19
    if len(some):
        # Whole fingerprints at a time.
        some = some[np.argsort(sizes_at[some], kind="stable")]
        ends = np.flatnonzero(np.append(np.diff(sizes_at[some]) != 0, True)) + 1
        start = 0
        while start < len(some):
            stop = ends[min(np.searchsorted(ends, start + step), len(ends) - 1)]
            _mark_first(some[start:stop], context, h, before, after, kept, length)
            start = stop
    bits = [r.tobytes() if k else None for r, k in zip(np.packbits(kept, axis=1), kept.any(axis=1))]
    yield pa.RecordBatch.from_arrays(
        [*(places.column(c).combine_chunks() for c in ("block", "hash", "doc", "th", "at")), pa.array(bits, pa.binary())],
        ["block", "hash", "doc", "th", "at", "kept"],
    )


def _mark_first(some, context, h, before, after, kept, length):
    """``some``: places of whole fingerprints, for each in order of place."""
    group, left, right = h[some], before[some], after[some]
    onward = _padded([context[i][before[i]:] for i in some], length)
    backward = _padded([context[i][: before[i]][::-1] for i in some], length - SEED)
    classes = []
    for strings in (onward, backward):
        order = suffix_order(strings, group)
        classes.append((order, _common_prefixes(strings, order, group)))
    rank = np.empty((2, len(some)), np.int64)
    for offset in range(length - SEED + 1):
        fits = np.flatnonzero((left >= offset) & (right >= length - offset))
        if not len(fits):
            continue
        for k, depth in enumerate((length - offset, offset)):
            order, shared = classes[k]
            rank[k, order] = np.cumsum(shared < depth)
        _, first = np.unique(rank[0, fits] * (len(some) + 1) + rank[1, fits], return_index=True)
        kept[some[fits[first]], offset] = True


# --- removal -------------------------------------------------------------------------------------

def _cleaned(docs, notes, length):
    out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
    known = _known(notes)
    marks = notes.filter(notes.column("kept").is_valid())
    stays = dict(zip(zip(*(marks.column(c).to_pylist() for c in ("doc", "th", "at"))), marks.column("kept").to_pylist()))
    if len(docs):
        doc, th = _rows_of(docs)
        for part in slices(docs.column("data")):
            runs = _Runs(part, length)
            n = len(part.data)
            change = np.zeros(n + 1, np.int64)
            hit = np.flatnonzero(_among(runs.hash, known))
            for i in hit:
                row, at, first, last = int(runs.row[i]), int(runs.at[i]), int(runs.first[i]), int(runs.last[i])
                bits = stays.get((int(doc[part.first_row + row]), int(th[part.first_row + row]), at - int(part.offsets[row])))
                if bits is None:
                    change[first] += 1
                    change[last + length] -= 1
                else:
                    flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=length - SEED + 1)
                    gone = at - np.flatnonzero(flags[at - last: at - first + 1] == 0) - (at - last)
                    np.add.at(change, gone, 1)
                    np.add.at(change, gone + length, -1)
            removed = np.cumsum(change[:-1]) > 0
            for r in range(len(part)):
                a, b = part.offsets[r], part.offsets[r + 1]
                gone = removed[a:b]
                rises = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if b > a else 0
                bytes_left = part.data[a:b][~gone]
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(rises)
                out["kept_sha256"].append(hashlib.sha256(bytes_left.tobytes()).hexdigest())
                out["kept_text"].append(_whole_characters(part.data[a:b], gone) if rises else bytes_left.tobytes())
    return pa.table({
        "rest": docs.column("rest"),
        **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
        "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept_text": pa.array(out["kept_text"], pa.binary()),
    })


def _whole_characters(data, gone):
    """Bytes of the characters that do not lie wholly in removed runs."""
    character = np.cumsum((data & 0xC0) != 0x80)
    stays = np.zeros(character[-1] + 1, bool)
    stays[character[~gone]] = True
    return data[stays[character]].tobytes()
