"""Secret scans, in DataFrame functions only: patterns and sliding-window entropy.

Three patterns give the base kinds: ``assign`` (a name such as password, a sign and a value of
``VALUE`` characters or more), ``access`` (AKIA and capitals or digits, ``ACCESS`` or more) and
``hex`` (``HEX`` or more lower-case hex digits). Matches are leftmost and do not overlap; short ones
are dropped after matching, so they still use up their text.

Entropy adds one kind per character class (``CLASSES``). Candidates are the longest runs of the class
that are at least a window long. A window slides over the candidate by one character: the sum of
c * log2(c) over its character counts c loses the term of the character that leaves and gains that of the
one that enters, so nothing is counted anew but these two. The Shannon entropy is log2(W) less
that sum over W. The span goes from the first window that reaches the class's entropy to the last one.
Sums are integers (``SCALE``), so that they do not depend on the order of additions.

The allow-list suppresses candidates that are no secrets: only digits or only letters, a UUID, or a text
that holds a placeholder of ``PLACEHOLDERS`` in either case; a base64 candidate of hex digits only is
left to the hex class.

Nothing is shuffled: a document is one row throughout. Work and memory follow the length of a text and
the number of its matches; positions are prefix sums in chunks, so many matches cost n^1.5 and not n^2.

Defined cases: null text is empty and has no spans. Positions count code points; ends are exclusive.
Columns of ``docs`` that an added one would clash with are replaced; repeated rows stay repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE, ACCESS, HEX = 8, 16, 32
SCALE = 1_000_000
_CHUNK = 256

# Kind, pattern (Java syntax).
BASE = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
              r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    # Shorter runs would be dropped: a run is matched from its first digit, whole.
    "hex": rf"[0-9a-f]{{{HEX},}}+",
}
# Kind: (characters of the class, window, least entropy in bits).
CLASSES = {"entropy_hex": ("0-9A-Fa-f", 16, 2.9), "entropy_base64": ("0-9A-Za-z+/_-", 20, 3.7)}
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "0123456789", "abcdefgh", "xxxx")
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
KINDS = (*BASE, *CLASSES)
# What every match of a kind holds, quicker to look for than the match: a sign after the last letter of a
# name, the first letters of a key, and for a candidate of digits and letters a digit beside another character.
_MIXED = r"[0-9](?:[A-Za-z+/_-]|(?<=[A-Za-z+/_-][0-9]))"
_HINTS = {"assign": r"""[DdTtNnYy]["']?\x20*[:=]""", "entropy_hex": _MIXED, "entropy_base64": _MIXED}
ADDED = ("n_assign", "n_access", "n_hex", "n_entropy", "secrets")


def secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_entropy and secrets, an array of kind, start and end
    in order of start, then kind."""
    p = _free_prefix(docs, "secret_scan_")
    col = lambda name, kind: F.col(f"{p}{name}_{kind}")
    every = lambda name, value, kinds=KINDS: {f"{p}{name}_{k}": value(k) for k in kinds}
    text = F.coalesce("text", F.lit(""))
    patterns = BASE | {k: rf"(?<![{c}])[{c}]{{{w},}}+" for k, (c, w, _) in CLASSES.items()}
    none = F.array().cast("array<string>")
    # Each step is a projection of its own, so that no lambda evaluates an array anew per element.
    hint = lambda k: F.contains(text, F.lit("AKIA")) if k == "access" else text.rlike(_HINTS[k]) if k in _HINTS else F.lit(True)
    rows = docs.withColumns(every("has", lambda k: hint(k) & text.rlike(patterns[k])))
    extracted = lambda k, group: F.when(col("has", k), F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(group))).otherwise(none)
    rows = rows.withColumns(
        every("match", lambda k: extracted(k, 0))
        | every("value", lambda k: extracted(k, 2), ("assign",))
        | every("gap", lambda k: F.when(col("has", k), F.split(text, patterns[k], -1)).otherwise(none)))
    rows = rows.withColumns(
        every("steps", lambda k: F.transform(col("match", k), lambda m, i: F.length(F.get(col("gap", k), i)) + F.length(m)))
        | every("bytes", lambda k: F.transform(col("match", k), lambda m: m.cast("binary")), CLASSES))
    rows = rows.withColumns(every("before", lambda k: _chunk_starts(col("steps", k))))
    rows = rows.withColumns(
        every("end", lambda k: _ends(col("steps", k), col("before", k)))
        | every("window", lambda k: F.transform(col("bytes", k), lambda b: high_entropy(b, *CLASSES[k][1:])), CLASSES))
    rows = rows.withColumns(every("span", lambda k: _spans(k, lambda name: col(name, k))))
    found = F.sort_array(F.concat(*[col("span", k) for k in KINDS]))
    name = F.array(*map(F.lit, KINDS))
    added = {f"n_{k}": F.size(col("span", k)).cast("long") for k in BASE} | {
        "n_entropy": sum((F.size(col("span", k)) for k in CLASSES), F.lit(0)).cast("long"),
        "secrets": F.transform(found, lambda s: F.struct(
            F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
    }
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED], *[v.alias(k) for k, v in added.items()])


def spans_text(found: str | Column, kinds=KINDS) -> Column:
    """Spans of some kinds as kind:start:end, comma-joined."""
    some = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _spans(kind, col):
    """Array of (start, kind, end) of the matches that count."""
    number = F.lit(KINDS.index(kind))
    size = lambda i: F.length(F.get(col("match"), i))

    def span(end, i):
        if kind in CLASSES:
            start, window = end - size(i), F.get(col("window"), i)
            whole = F.struct((start + window["first"] - 1).alias("start"), number.alias("kind"), (start + window["last"]).alias("end"))
            return F.when((window["last"] > 0) & ~_allowed(F.get(col("match"), i), kind), whole)
        whole = F.struct((end - size(i)).alias("start"), number.alias("kind"), end.alias("end"))
        if kind == "assign":
            return F.when(F.length(F.get(col("value"), i)) >= VALUE, whole)
        return F.when(size(i) >= {"access": ACCESS, "hex": HEX}[kind], whole)

    return F.filter(F.transform(col("end"), span), lambda s: s.isNotNull())


def _allowed(candidate, kind):
    """Whether the allow-list suppresses a candidate."""
    out = ~candidate.rlike("[0-9]") | ~candidate.rlike("[A-Za-z]") | candidate.rlike(f"^{UUID}$")
    for word in PLACEHOLDERS:
        out = out | F.contains(F.lower(candidate), F.lit(word))
    return out | ~candidate.rlike("[^0-9A-Fa-f]") if kind == "entropy_base64" else out


# --- entropy -------------------------------------------------------------------------------------

def terms(window: int) -> list[int]:
    """c * log2(c) for c = 0 .. ``window``, times ``SCALE``."""
    return [0, *(round(SCALE * c * math.log2(c)) for c in range(1, window + 1))]


def most_terms(window: int, entropy: float) -> int:
    """Largest sum of terms at which a window has at least ``entropy`` bits."""
    return math.floor(SCALE * window * (math.log2(window) - entropy))


def high_entropy(data: Column, window: int, entropy: float) -> Column:
    """(first, last) of an ASCII binary: first place of the first window of enough entropy, and last place
    of the last one, from 1; last is 0 without any."""
    term = F.array(*[F.lit(t).cast("long") for t in terms(window)])
    limit = most_terms(window, entropy)

    def moved(state, i):
        full = i > window
        # The window before this character, and what stays of it.
        size = F.least(F.lit(window), i - 1)
        held = F.substring(data, F.greatest(F.lit(1), i - window), size).cast("string")
        stays = F.substring(data, F.greatest(F.lit(1), i - window + 1), F.least(F.lit(window - 1), i - 1)).cast("string")
        leaves = _count(held, F.substring(held, 1, 1))
        enters = _count(stays, F.substring(data, i, F.lit(1)).cast("string"))
        lost = F.when(full, F.get(term, leaves) - F.get(term, leaves - 1)).otherwise(0)
        total = state["total"] - lost + F.get(term, enters + 1) - F.get(term, enters)

        def noted(now):
            good = (i >= window) & (now <= limit)
            return F.struct(
                now.alias("total"),
                F.when(good & (state["first"] == 0), i - window + 1).otherwise(state["first"]).alias("first"),
                F.when(good, i).otherwise(state["last"]).alias("last"))

        return F.get(F.transform(F.array(total), noted), 0)

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(data)), start, moved)


def _count(text, character):
    return F.length(text) - F.length(F.replace(text, character, F.lit("")))


# --- positions -----------------------------------------------------------------------------------

def _chunks(steps):
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK)).cast("int"))


def _chunk(steps, number):
    return F.slice(steps, number * _CHUNK + 1, _CHUNK)


def _chunk_starts(steps):
    """Sum of all steps before each chunk."""
    sums = F.transform(_chunks(steps), lambda n: F.aggregate(_chunk(steps, n), F.lit(0), lambda a, x: a + x))
    return F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _ends(steps, before):
    """Sum of all steps up to and with each."""
    within = lambda n: F.aggregate(
        _chunk(steps, n), F.array(F.get(before, n)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.flatten(F.transform(_chunks(steps), lambda n: F.slice(within(n), 2, _CHUNK)))


def _free_prefix(docs, prefix):
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix
