"""Line-first cleaning, in DataFrame functions only.

Every line of a document is judged by itself. A line fails

* punctuation: it holds more exclamation and question marks than words, or has fewer than
  ``SHORT`` words and does not end in a mark;
* navigation: more than one symbol of ``SYMBOLS`` for four words, or two and more separators
  between few words;
* boilerplate: it holds a phrase of ``BOILERPLATE``;
* repetition: it equals an earlier line.

Failed lines go. A document is rejected when that takes more than ``MOST_LOST`` per cent of its
word characters, or when it fails the base rules: fewer than ``FEW_WORDS`` words, or more than
``MOST_REPEATED`` per cent of its words in three-word windows found twice.

Defined cases: null text has no words and fails; empty lines count nowhere. Windows are compared by
64-bit fingerprints. A document is one row throughout; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_WORDS, MOST_REPEATED, MOST_LOST, SHORT = 50, 50, 50, 3
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
MARKS = ".!?:;,\"')]"

# Phrases of page furniture, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
    "enable javascript", "lorem ipsum", "click here", "skip to content", "back to top",
)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    kept and cleaned_text. The text's lines and words are held in columns of a reserved prefix meanwhile."""
    p = _free_prefix(docs, "line_quality_")
    col = lambda name: F.col(p + name)
    text = F.coalesce("text", F.lit(""))
    has_word = lambda x: F.length(F.translate(x, _SPACES, "")) > 0
    # Each step is a projection of its own, so that no lambda evaluates an array anew per element.
    rows = docs.withColumns({
        p + "words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        p + "lines": F.filter(F.split(text, "\n"), has_word),
        p + "chars": _length_without(text, _SPACES),
        p + "symbols": F.length(text) - _length_without(text, SYMBOLS),
    })
    rows = rows.withColumns({p + "n": F.size(col("words")), p + "distinct": F.array_distinct(col("lines"))})
    window = lambda i: F.struct(
        F.xxhash64(F.get(col("words"), i), F.get(col("words"), i + 1), F.get(col("words"), i + 2)).alias("h"), i.alias("i"))
    starts = F.when(col("n") >= 3, F.sequence(F.lit(0), col("n") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(p + "sorted", F.sort_array(F.transform(starts, window)))
    twice = F.transform(
        col("sorted"),
        lambda x, j: F.when(
            x["h"].eqNullSafe(F.get(col("sorted"), j + 1)["h"]) | x["h"].eqNullSafe(F.get(col("sorted"), j - 1)["h"]), x["i"]),
    )
    rows = rows.withColumn(p + "twice", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    # A window covers three words, or fewer if the next one starts before its end.
    covered = F.transform(col("twice"), lambda i, j: F.coalesce(F.least(F.lit(3), F.get(col("twice"), j + 1) - i), F.lit(3)))
    rows = rows.withColumns({
        p + "repeated": F.aggregate(covered, F.lit(0), lambda a, x: a + x),
        p + "good": F.filter(col("distinct"), line_passes),
    })
    left = F.aggregate(F.transform(col("good"), lambda x: _length_without(x, _SPACES)), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumns({p + "lost": col("chars") - left})
    failed = (col("n") < FEW_WORDS) | (100 * col("repeated").cast("long") > MOST_REPEATED * col("n").cast("long"))
    lost = 100 * col("lost").cast("long") > MOST_LOST * col("chars").cast("long")
    added = {
        "n_words": col("n").cast("long"), "word_chars": col("chars").cast("long"), "n_symbols": col("symbols").cast("long"),
        "n_dup_lines": (F.size(col("lines")) - F.size(col("distinct"))).cast("long"),
        "n_repeat_words": col("repeated").cast("long"), "base_failed": failed, "lost_chars": col("lost").cast("long"),
        "kept": ~failed & ~lost, "cleaned_text": F.array_join(col("good"), "\n"),
    }
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def line_passes(line: Column) -> Column:
    """Whether a line that has a word passes every rule but repetition."""
    words = F.regexp_count(line, F.lit(WORD))
    shouts = F.length(line) - _length_without(line, "!?")
    symbols = F.length(line) - _length_without(line, SYMBOLS)
    separators = F.length(line) - _length_without(line, "|>»•·")
    ending = F.substring(F.rtrim(F.translate(line, "\t\x0b\x0c\r", "    ")), -1, 1)
    fragment = (words < SHORT) & ~F.contains(F.lit(MARKS), ending)
    low = F.lower(line)
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(low, F.lit(phrase))
    return ~((shouts > words) | fragment | (4 * symbols > words) | ((separators >= 2) & (4 * separators > words)) | furniture)


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _free_prefix(docs, prefix):
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix
