"""Column helpers for the places where Spark's own functions differ from the query text."""

from bidstream.functions.text import (
    channel_code,
    channel_id,
    count_char,
    has_channel_id,
    is_named,
    matched_group,
    path_part,
    path_part_or_null,
    register_sql_functions,
)
from bidstream.functions.times import (
    day_of,
    hop_starts,
    micros_of,
    minute_number,
    minute_of,
    minute_text,
    part_of_day,
    seconds_of,
    slice_of,
)

__all__ = [
    "channel_code", "channel_id", "count_char",
    "has_channel_id", "is_named", "matched_group", "path_part", "path_part_or_null",
    "register_sql_functions", "day_of", "hop_starts", "micros_of", "minute_number", "minute_of",
    "minute_text", "part_of_day", "seconds_of", "slice_of",
]
