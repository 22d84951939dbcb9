"""Hot keys of a join, from mergeable heavy-hitter sketches, and the salts that spread them.

A sketch keeps at most ``tracked`` keys, whatever it has read, and overcounts none by more than rows / tracked
or so. Sketches of parts of the data, of days for instance, combine to one of the whole. A key is hot when
it has more than half a fair part of all rows, so at most twice as many keys as parts are.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 10_000


def key_sketch(rows: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """One row: ``sketch`` of a key column and ``rows``, those whose key is not null."""
    return rows.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("rows"))


def combined(sketches: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One sketch of the rows of all ``sketches``."""
    return sketches.agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("rows").alias("rows"))


def hot_keys(sketch: DataFrame, parts: int) -> tuple:
    """Keys with more than rows / (2 * ``parts``) rows, in order. At most 2 * ``parts`` and an error term reach the driver."""
    found = sketch.where("rows > 0").select("rows", F.explode(F.expr(f"approx_top_k_estimate(sketch, {2 * parts})")).alias("hit"))
    hot = found.where(2 * parts * F.col("hit.count") > F.col("rows")).select("hit.item").collect()
    return tuple(sorted(r.item for r in hot))


def part_of(key: str, hot: tuple | None, salts: int, *spread_by: str) -> Column:
    """The part of a row of the larger side: one of ``salts`` for a hot key, else 0. All are hot if ``hot`` is None."""
    part = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    return part if hot is None else F.when(F.col(key).isin(*hot), part).otherwise(0) if hot else F.lit(0)


def parts_of(key: str, hot: tuple | None, salts: int) -> Column:
    """The parts that a row of the smaller side is copied to."""
    every, first = F.array(*[F.lit(n) for n in range(salts)]), F.array(F.lit(0))
    return every if hot is None else F.when(F.col(key).isin(*hot), every).otherwise(first) if hot else first
