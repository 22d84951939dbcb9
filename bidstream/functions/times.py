from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(time) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def minute_of(time) -> Column:
    """Hour and minute, 24-hour clock."""
    return F.date_format(time, "HH:mm")


def minute_number(time) -> Column:
    """Minute of the day. Unlike a text it can be aggregated by hashing."""
    return F.hour(time) * 60 + F.minute(time)


def minute_text(number) -> Column:
    """``minute_of`` of a minute of the day."""
    number = F.col(number) if isinstance(number, str) else number
    parts = F.floor(number / 60), number % 60
    joined = F.concat_ws(":", *[F.lpad(part.cast("string"), 2, "0") for part in parts])
    return F.when(number.isNotNull(), joined)


def part_of_day(time) -> Column:
    """dayTime from 8 through 18 h, nightTime from 20 through 6 h, otherTime at 7 and 19 h."""
    hour = F.hour(time)
    return (
        F.when((hour >= 8) & (hour <= 18), "dayTime")
        .when((hour <= 6) | (hour >= 20), "nightTime")
        .otherwise("otherTime")
    )


def micros_of(interval: str) -> int:
    """Length in microseconds of a text such as '10 seconds'."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    amount, unit = interval.split()
    return int(amount) * units[unit.rstrip("s")] * 1_000_000


def seconds_of(interval: str) -> int:
    return micros_of(interval) // 1_000_000


def slice_of(time, width: str) -> Column:
    """Start, in epoch microseconds, of the ``width``-wide slice a time falls in; never NULL."""
    micros = F.unix_micros(time)
    return F.coalesce(micros - F.pmod(micros, F.lit(micros_of(width))), F.lit(-(1 << 63)))


def hop_ends(time, size: str, slide: str) -> tuple[Column, Column]:
    """Starts, in epoch microseconds, of the oldest and the newest sliding window that hold a time; the oldest
    is the later one if none does."""
    step, length = micros_of(slide), micros_of(size)
    micros = F.unix_micros(time)
    before = micros - F.lit(length)
    return before - F.pmod(before, F.lit(step)) + F.lit(step), micros - F.pmod(micros, F.lit(step))


def hop_starts(time, size: str, slide: str) -> Column:
    """Starts, in epoch microseconds, of every sliding window that holds a time."""
    step, length = micros_of(slide), micros_of(size)
    newest = slice_of(time, slide)
    starts = F.array(*[newest - F.lit(n * step) for n in range(-(-length // step))])
    if length % step == 0:
        return starts
    return F.filter(starts, lambda start: start + length > F.unix_micros(time))
