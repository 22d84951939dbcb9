"""MinHash near-deduplication with sequential Bayesian verification.

Documents are linked when the Jaccard similarity of their sets of five-word shingles reaches
``threshold`` per cent: 85 in op2, 80 in the pipeline.

1. A sketch per document: set size, fingerprint of its words, MinHash signature.
2. Texts of equal words become one class, represented by the smallest doc_id. A doc_id with several
   texts has a class for each; classes are compared, and links between them become links of doc_ids.
3. Signatures are cut into bands; classes that agree in a band are candidates. At the threshold a
   pair shares no band with probability (1 - t^ROWS)^bands, at most 8e-7 at any threshold: 24 bands
   at 0.85, 36 at 0.8.
4. Candidates are compared with a hub, not with each other: in up to ``HUB_ROUNDS`` rounds a member with
   the best hub of its buckets that it is not connected to, members of the largest buckets being hubs. What buckets
   then still hold of different components is compared where exact prefix and position bounds on the sets
   allow a link. So no pair of a bucket is lost, and a large group costs a few comparisons per member.
5. Verification: signatures are compared in batches; after n hashes with m agreements the posterior
   of the similarity under a uniform prior is Beta(m + 1, n - m + 1), and the pair is dropped once
   P(similarity >= t) falls below MISS. Survivors are verified on their full shingle sets.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; with one to four
words the whole sequence is the only shingle; null text or no words give an empty set, which is linked
with nothing. Rows of one doc_id count as one document for links. A null doc_id is linked with nothing
and kept. Shingles are compared as 64-bit fingerprints.
"""

from __future__ import annotations

import math
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidstream import workspace
from bidstream.llm.components import components
from bidstream.llm.tables import ship, stored
from bidstream.llm.texts import mixed, slices

THRESHOLD = 85  # per cent
WIDTH = 5
BANDS, ROWS = 24, 5  # bands at THRESHOLD and above; see bands_of
BATCH = 24  # signature hashes compared at a time
MISS = 1e-9
HUB_ROUNDS = 4
HUB_NODES = 512  # compared with one copy of a hub
SIEVE_BITS = 22

_HASHES = BANDS * ROWS
_generator = np.random.Generator(np.random.PCG64(11))
_FACTORS = _generator.integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _generator.integers(1, 1 << 63, _HASHES, dtype=np.uint64)
_POSITION = _generator.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SKETCH = "doc_id long, version long, n_shingles long, words_a long, words_b long, signature binary"


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    spark = docs.sparkSession
    ship(spark)
    with workspace.temporary(spark) as keep:
        return stored(_labelled(docs, threshold), "near-duplicates", keep)


def _labelled(docs, threshold):
    bands = bands_of(threshold)
    versions = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    sketches = stored(versions.mapInArrow(partial(_sketches, hashes=bands * ROWS), _SKETCH), "sketches")
    some = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A document with several texts stands for several classes: a node is a class, not a doc_id.
    first = some.groupBy("words_a", "words_b").agg(F.min(F.struct("doc_id", "version", "signature")).alias("first"))
    classes = stored(first.select(F.monotonically_increasing_id().alias("node"), "words_a", "words_b", "first.*"), "classes")
    members = stored(_candidates(classes, bands), "members")
    nodes = members.select("node").distinct()
    # Only what can be a candidate is shuffled: the rest leaves at a broadcast bit map.
    candidates = stored(_sifted(classes, nodes, ["node"]).join(nodes.hint("merge"), "node"), "candidates")
    keys, signatures = candidates.select("node", "doc_id", "version"), candidates.select("node", "signature")
    texts = stored(
        _sifted(versions, keys, ["doc_id", "version"]).join(keys, ["doc_id", "version"]).select("node", "text").dropDuplicates(["node"]), "texts")
    links = _links(members, signatures, texts, threshold)
    for end in ("a", "b"):
        links = links.join(keys.select(F.col("node").alias(end), F.col("doc_id").alias(f"doc_{end}")).hint("merge"), end)
    links = links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).where("a != b")
    of_class = classes.select("words_a", "words_b", F.col("doc_id").alias("class"))
    same = some.select("doc_id", "words_a", "words_b").join(of_class, ["words_a", "words_b"]).where("doc_id != class").select(
        F.col("doc_id").alias("a"), F.col("class").alias("b"))
    labels = components(same.unionByName(links))
    return (
        sketches.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            (F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        )
    )


def _sifted(rows, keys, names):
    """``rows`` without most of those whose ``names`` are not among ``keys``.

    One bit per hash of a key, in 2^``SIEVE_BITS`` bits: at most 2^(``SIEVE_BITS`` - 6) rows of two longs
    are broadcast, whatever the number of keys. With very many keys it only lets more rows through.
    """
    hashed = F.xxhash64(*names)
    word, bit = F.shiftrightunsigned(hashed, 64 - SIEVE_BITS + 6), F.expr(f"shiftleft(1L, cast(xxhash64({', '.join(names)}) & 63 as int))")
    bits = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    return rows.join(F.broadcast(bits), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)).drop("_word", "_bits")


def without_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component: rows of ``docs`` whose doc_id is its component's smallest."""
    gone = near_duplicates(docs, threshold).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])


def bands_of(threshold: int) -> int:
    """Bands that miss a pair at the threshold no more often than ``BANDS`` do at ``THRESHOLD``."""
    if threshold >= THRESHOLD:
        return BANDS
    missed = [math.log1p(-(t / 100) ** ROWS) for t in (THRESHOLD, threshold)]
    return math.ceil(BANDS * missed[0] / missed[1])


# --- shingles and sketches -----------------------------------------------------------------------

def shingle_sets(column):
    """For each text of an Arrow column the sorted distinct shingle fingerprints, and its words' hash."""
    for part in slices(column):
        low = part.lower()
        starts, ends, row = low.words()
        h = low.span_hashes(starts, ends)
        edges = np.searchsorted(row, np.arange(len(part) + 1))
        grams = np.zeros(0, np.uint64)
        if len(h) >= WIDTH:
            grams = sum((h[i: len(h) - WIDTH + 1 + i] * _POSITION[i] for i in range(1, WIDTH)), h[: len(h) - WIDTH + 1] * _POSITION[0])
            grams = mixed(grams)
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a >= WIDTH:
                found = np.unique(grams[a: b - WIDTH + 1])
            elif b > a:
                found = mixed((h[a:b] * _POSITION[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                found = grams[:0]
            yield found, h[a:b]


@cache
def _functions(hashes: int):
    """Factors and terms of so many hash functions; the first are the same for any number."""
    more = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, (max(0, hashes - _HASHES), 2), dtype=np.uint64)
    factors = np.concatenate([_FACTORS, more[:, 0] * np.uint64(2) + np.uint64(1)])[:hashes]
    return factors[:, None], np.concatenate([_TERMS, more[:, 1]])[:hashes, None]


def signature_of(shingles: np.ndarray, hashes: int = _HASHES) -> np.ndarray:
    factors, terms = _functions(hashes)
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (factors * shingles[i: i + 2048] + terms).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(batches, hashes):
    order = np.arange(1 << 16, dtype=np.uint64)
    for batch in batches:
        sizes, first, second, signatures = [], [], [], []
        for shingles, words in shingle_sets(batch.column("text")):
            sizes.append(len(shingles))
            if len(words) > len(order):
                order = np.arange(2 * len(words), dtype=np.uint64)
            # Two independent fingerprints of the word sequence.
            at = order[: len(words)]
            first.append(int(mixed(words + mixed(at)).sum().view(np.int64)) if len(words) else 0)
            second.append(int(mixed(words * np.uint64(0x9E3779B97F4A7C15) ^ mixed(at + np.uint64(1 << 40))).sum().view(np.int64)) if len(words) else 0)
            signatures.append(signature_of(shingles, hashes).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("version"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
             pa.array(second, pa.int64()), pa.array(signatures, pa.binary())],
            ["doc_id", "version", "n_shingles", "words_a", "words_b", "signature"],
        )


# --- candidates ----------------------------------------------------------------------------------

def _candidates(sketches, bands):
    """(bucket, node) of classes that share a bucket with another class."""
    keys = sketches.select("node", "signature").mapInArrow(partial(_band_keys, bands=bands), "bucket long, node long")
    shared = keys.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return keys.join(shared.select("bucket"), "bucket", "left_semi")


def _band_keys(batches, bands):
    names = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        signatures = _matrix(batch.column("signature"), bands * ROWS).reshape(-1, bands, ROWS).astype(np.uint64)
        h = np.broadcast_to(names, signatures.shape[:2]).copy()
        for i in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, :, i])
        doc = np.repeat(batch.column("node").to_numpy(), bands)
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(doc)], ["bucket", "node"])


def _matrix(column, hashes):
    _, _, data = column.buffers()
    first = column.offset
    return np.frombuffer(data, np.uint32)[first * hashes: (first + len(column)) * hashes].reshape(-1, hashes) if len(column) else np.zeros((0, hashes), np.uint32)


def _links(members, signatures, texts, threshold):
    """Verified links that connect every pair of a bucket that is similar.

    In a round every member is compared with one hub: of the hubs of its buckets, the best. So a round
    has at most one pair per member, however many buckets a group of copies shares. The rounds end early if
    they find little; the rest is left to ``_compatible``.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    # Nodes that share buckets with many others are similar to most of them: as hubs they link a group in few rounds.
    central = members.join(sizes.hint("merge"), "bucket").groupBy("node").agg(F.sum("size").cast("double").alias("met"))
    members = stored(members.join(central.hint("merge"), "node").select("bucket", "node", "met", F.col("node").alias("component")), "members")
    links = compared = None
    for round_ in range(HUB_ROUNDS):
        # The most central ones first, then others of them, by a hash of the round.
        chance = F.crc32(F.concat_ws(":", "node", F.lit(round_)))
        ranked = members.withColumn("rank", F.struct(F.col("met") * (chance if round_ else 1), chance))
        hubs = ranked.groupBy("bucket").agg(
            F.max_by("node", "rank").alias("hub"), F.max_by("component", "rank").alias("hub_component"), F.max("rank").alias("hub_rank"))
        met = members.join(hubs.hint("merge"), "bucket").where("component != hub_component")
        if compared is not None:
            met = met.join(compared.hint("merge"), ["node", "hub"], "left_anti")
        pairs = stored(met.groupBy("node").agg(F.max_by("hub", "hub_rank").alias("hub")), "pairs")
        found = stored(verified(pairs, signatures, texts, threshold), "links")
        links = found if links is None else links.unionByName(found)
        compared = pairs if compared is None else compared.unionByName(pairs)
        if round_ == HUB_ROUNDS - 1 or 100 * found.count() <= pairs.count():
            break  # the comparisons of a further round would find little that the next step does not
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = stored(ends.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node"), "degrees")
        # Members linked to one and the same document are connected: its best-linked neighbour,
        # or itself, names a member's component as far as it is known.
        near = ends.join(degree.hint("merge"), F.col("b") == F.col("node")).select("a", "b", "degree").unionByName(
            degree.select(F.col("node").alias("a"), F.col("node").alias("b"), "degree"))
        labels = near.groupBy("a").agg(
            F.max_by("b", F.col("degree") * F.lit(1 << 32) + F.crc32(F.col("b").cast("string"))).alias("component"))
        members = stored(_unsettled(members, labels.withColumnRenamed("a", "node"), compared), "members")
    # From here on, components are those of all links so far.
    members = _unsettled(members, components(links), compared)
    pairs = _compatible(members.groupBy("node").agg(F.min("component").alias("component")), texts, threshold)
    return links.unionByName(verified(pairs, signatures, texts, threshold))


def _unsettled(members, labels, compared):
    """Members, with their components, of buckets of several components; not those of two members
    that have been compared."""
    members = members.select("bucket", "node", "met").join(labels.hint("merge"), "node", "left").select(
        "bucket", "node", "met", F.coalesce("component", "node").alias("component"))
    open_ = members.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("a"), F.max("node").alias("b"),
        F.count(F.lit(1)).alias("size")).where("low < high")
    done = compared.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.lit(2).cast("long").alias("size")).distinct()
    open_ = open_.join(done.hint("merge"), ["a", "b", "size"], "left_anti")
    return members.join(open_.select("bucket").hint("merge"), "bucket", "left_semi")


def _compatible(members, texts, threshold):
    """Pairs of different components that may be similar, by exact prefix and position bounds.

    Sets are ordered by the frequency of their shingles. Similar sets of sizes n and m share at least
    t / (1 + t) * (n + m) shingles, so they share one early enough in both orders that this many can
    still follow. Copies with many edits of their own start with shingles nobody else has.
    """
    t = threshold / 100
    early_places = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1
    sides = texts.join(members.hint("merge"), "node").select("node", "component", "text")
    kind = "node long, component long, n int, shingle long"
    once = sides.mapInArrow(_shingle_rows, kind).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("often"), *[F.min(c).alias(c) for c in ("node", "n")]).where("often = 1")
    # Texts whose early places are all taken by shingles of their own are similar to none of the others:
    # they go before the join.
    alone = once.groupBy("node").agg(F.count(F.lit(1)).alias("own"), F.max("n").alias("n")).where(F.col("own") >= early_places)
    sides = stored(sides.join(alone.select("node").hint("merge"), "node", "left_anti"), "open-texts")
    rows = sides.mapInArrow(_shingle_rows, kind)
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Shingles of one document come first in its order and join with nothing: their number is enough.
    shared = rows.join(often.hint("merge"), "shingle")
    order = Window.partitionBy("node").orderBy("often", "shingle")
    placed = shared.withColumn("at", F.row_number().over(order)).withColumn(
        "at", F.col("at") + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node")))
    early = stored(placed.where(F.col("at") <= early_places).select(
        "node", "component", "n", "shingle", "at"), "prefixes")
    other = early.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "component", "n", "at")])
    most = 1 + F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return early.join(other.hint("merge"), "shingle").where(
        (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b"))
        & (most >= F.lit(t / (1 + t)) * (F.col("n") + F.col("n_b")) - 1e-9)
    ).select(F.col("node_b").alias("node"), F.col("node").alias("hub")).distinct()


def _shingle_rows(batches):
    for batch in batches:
        sets = [s for s, _ in shingle_sets(batch.column("text"))]
        sizes = [len(s) for s in sets]
        repeat = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
        for i in range(0, max(1, sum(sizes)), 1 << 17):
            some = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(repeat(c)[some]) for c in ("node", "component")],
                 pa.array(np.repeat(sizes, sizes)[some].astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)[some])],
                ["node", "component", "n", "shingle"])


# --- verification --------------------------------------------------------------------------------

def verified(pairs, signatures, texts, threshold):
    """Similar ones of the pairs (node, hub) as (a, b): Bayesian pruning of signatures, then full sets.

    The pairs of a hub come to one task, which holds the hub's side while its nodes stream by; a hub of
    many nodes is copied once for each ``HUB_NODES`` of them. Each node's side is sent once per pair.
    """
    hashes = bands_of(threshold) * ROWS
    copies = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_NODES).alias("copies"))
    pairs = stored(pairs.join(copies.hint("merge"), "hub").select(
        "node", "hub", F.pmod(F.xxhash64("node"), F.col("copies")).alias("copy")), "pairs")
    some = _beside_hub(pairs, signatures, "signature").mapInArrow(
        partial(_plausible, least=least_agreements(threshold / 100, hashes), hashes=hashes), _PAIR)
    some = stored(some, "pairs")
    return _beside_hub(some, texts, "text").mapInArrow(partial(_similar, threshold=threshold), _PAIR).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


_PAIR = "node long, hub long, copy long"


def _beside_hub(pairs, sides, column):
    """Rows of each hub and copy: the hub's own first, then those of its nodes."""
    hubs = pairs.select("hub", "copy").distinct().withColumn("node", F.col("hub"))
    rows = hubs.withColumn("member", F.lit(0)).unionByName(pairs.select("hub", "copy", "node", F.lit(1).alias("member")))
    # No bit map here: over all rounds their broadcasts would pile up on the driver.
    rows = rows.join(sides.hint("merge"), "node").select("hub", "copy", "member", "node", column)
    return rows.repartition("hub", "copy").sortWithinPartitions("hub", "copy", "member")


def _by_hub(batches):
    """(batch, hub's row or None if it came before, rows of nodes) of each hub and copy."""
    for batch in batches:
        hub, copy, member = (batch.column(c).to_numpy() for c in ("hub", "copy", "member"))
        new = np.flatnonzero(np.append(True, (hub[1:] != hub[:-1]) | (copy[1:] != copy[:-1]))) if len(hub) else []
        for first, last in zip(new, [*new[1:], len(hub)]):
            own = first if member[first] == 0 else None
            yield batch, own, np.arange(first + (own is not None), last)


def _pairs_of(batch, rows):
    return batch.select(["node", "hub", "copy"]).take(pa.array(rows, pa.int64()))


def least_agreements(t: float, hashes: int = _HASHES, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, agreements that keep a pair): P(similarity >= t | agreements) >= miss.

    For Beta(m + 1, n - m + 1) this probability is that of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(BATCH, hashes + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _plausible(batches, least, hashes):
    own = None
    for batch, first, rows in _by_hub(batches):
        signatures = _matrix(batch.column("signature"), hashes)
        own = own if first is None else signatures[first].copy()
        open_, agreed = rows, np.zeros(len(batch), np.int64)
        for n, needed in least:
            agreed[open_] += (signatures[open_, n - BATCH: n] == own[n - BATCH: n]).sum(axis=1)
            open_ = open_[agreed[open_] >= needed]
        if len(open_):
            yield _pairs_of(batch, open_)


def _similar(batches, threshold):
    own = None
    for batch, first, rows in _by_hub(batches):
        texts, keep = batch.column("text"), []
        if first is not None:
            own = next(shingle_sets(texts.slice(first, 1)))[0]
        for i in rows:
            mine = next(shingle_sets(texts.slice(i, 1)))[0]
            common = len(np.intersect1d(mine, own, assume_unique=True))
            if 100 * common >= threshold * (len(mine) + len(own) - common):
                keep.append(i)
        if keep:
            yield _pairs_of(batch, keep)
