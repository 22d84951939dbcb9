from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Channels with a code of their own, and the URL parameter that holds the code.
CHANNEL_CODES = {"apple": "0", "google": "1", "facebook": "2", "baidu": "3"}
PARAMETER = "channel_id="


def count_char(text, char) -> Column:
    """Occurrences of the one-character ``char`` in ``text``."""
    text = F.col(text) if isinstance(text, str) else text
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("int")


def matched_group(text, pattern: str, group: int) -> Column:
    """Group of the first match of ``pattern``; NULL on a miss, '' if the group matched nothing.

    ``regexp_extract`` alone gives '' in both cases.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def has_channel_id(url, anchored: bool = True) -> Column:
    marked, mark = _marked(url, anchored)
    return F.contains(marked, F.lit(mark))


def channel_id(url, anchored: bool = True) -> Column:
    """Value of ``channel_id=`` in a URL; NULL when absent, '' when present but empty.

    Equals ``matched_group`` with ``(&|^)channel_id=([^&]*)`` (or, not ``anchored``, with
    ``channel_id=([^&]*)``), found by plain text search, which is many times faster.
    """
    marked, mark = _marked(url, anchored)
    rest = F.substr(marked, F.instr(marked, mark) + len(mark))
    return F.when(has_channel_id(url, anchored), F.substring_index(rest, "&", 1))


def _marked(url, anchored):
    """The text to search, and what to search for: a start of text counts as a separator."""
    url = F.col(url) if isinstance(url, str) else url
    return (F.concat(F.lit("&"), url), "&" + PARAMETER) if anchored else (url, PARAMETER)


def is_named(channel) -> Column:
    return F.lower(channel).isin(*CHANNEL_CODES)


def channel_code(channel, url, anchored: bool = True) -> Column:
    """Code of a well-known channel, else the id in the URL, else NULL."""
    lowered = F.lower(channel)
    code = None
    for name, value in CHANNEL_CODES.items():
        matches = lowered == name
        code = F.when(matches, value) if code is None else code.when(matches, value)
    return code.otherwise(channel_id(url, anchored))


def path_parts(url, last: int) -> Column:
    """'/'-separated parts of a text; everything after part ``last`` stays together."""
    return F.split(url, "/", last + 1)


def path_part(url, position: int, last: int | None = None) -> Column:
    """Part of a '/'-separated text, counted from 1; '' when there is no such part.

    Give neighbouring calls the same ``last``, and Spark splits the text once for all of them.
    """
    parts = path_parts(url, last or position)
    return F.when(F.size(parts) >= position, F.get(parts, F.lit(position - 1))).when(
        parts.isNotNull(), ""
    )


def path_part_or_null(url, index: int, last: int | None = None) -> Column:
    """Part of a '/'-separated text, counted from 0; NULL when there is no such part."""
    return F.get(path_parts(url, last or index + 1), F.lit(index))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``count_char`` callable from SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION count_char(s STRING, c STRING) RETURNS INT "
        "RETURN length(s) - length(replace(s, c, ''))"
    )
