"""Jobs over a bid dataset: statistics, their storage, truncation and replication."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidstream.functions import has_channel_id, is_named
from bidstream.operators.ordering import take_first
from bidstream.params import Params
from bidstream.schemas import DATASET_STATS
from bidstream.sinks.batch import _BID_ORDER

REQUIRED = tuple(DATASET_STATS.fieldNames())


def dataset_stats(bid: DataFrame, p: Params = Params()) -> DataFrame:
    """One row: size, key count, and the result sizes of the counted queries.

    ``bid`` needs a ``key`` column (NULL for lines without one). Result sizes follow the dataset
    definition: q16 counts (day, channel) pairs and q21 counts any ``channel_id=`` in the URL.
    ``channels`` and ``q21_anchored_rows`` are the sizes of q16_r and q21_r.
    """
    low, high = p.converted_range
    euros = F.col("price").cast("double") * float(p.dollar_rate)
    named = is_named("channel")
    flags = {
        "q2_expected_rows": F.col("auction").isin(*p.watched_auctions),
        "q14_expected_rows": (euros > low) & (euros < high),
        "q21_expected_rows": named | has_channel_id("url", anchored=False),
        "q21_anchored_rows": named | has_channel_id("url"),
    }
    # Each bid three times, under its auction, its channel and day, and its key: distinct counts
    # become counts of rows, reduced before the shuffle.
    ids = F.explode(F.array(
        _counted("auction", F.col("auction").cast("string")),
        _counted("channel", F.col("channel"), F.to_date("ts")),
        _counted("key", F.col("key")),
    )).alias("_id")
    per_id = (
        bid.select(ids, *[flag.alias(name) for name, flag in flags.items()])
        .groupBy("_id.kind", "_id.name", "_id.day")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(name).alias(name) for name in flags])
    )
    kind, name = F.col("kind"), F.col("name")

    def rows(column):
        return F.coalesce(F.sum(F.when(kind == "auction", F.col(column))), F.lit(0))

    return per_id.agg(
        rows("n").alias("total_rows"),
        F.count_if((kind == "key") & name.isNotNull()).alias("partitions"),
        *[rows(flag).alias(flag) for flag in flags],
        F.count_if((kind == "channel") & name.isNotNull() & F.col("day").isNotNull())
        .alias("q16_expected_rows"),
        F.count_if((kind == "auction") & name.isNotNull()).alias("q17_expected_rows"),
        F.countDistinct(F.when(kind == "channel", name)).alias("channels"),
    )


def _counted(kind, name, day=None):
    day = F.lit(None).cast("date") if day is None else day
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), day.alias("day"))


def expected_rows(stats: dict[str, int]) -> dict[str, int]:
    """Result size of each query that the statistics determine."""
    total = stats["total_rows"]
    sizes = {name: total for name in ("q0", "q0_r", "q1", "q1_r", "q1_r_both", "q10", "q22", "q22_r")}
    sizes.update(
        q2=stats["q2_expected_rows"], q2_r=stats["q2_expected_rows"],
        q14_r=stats["q14_expected_rows"], q21_r_anywhere=stats["q21_expected_rows"],
        q16=stats["q16_expected_rows"], q17_r=stats["q17_expected_rows"],
    )
    if "channels" in stats:
        sizes.update(
            q16_r=stats["channels"], q21=stats["q21_anchored_rows"], q21_r=stats["q21_anchored_rows"]
        )
    return sizes


def stats_path(dataset_path: str) -> str:
    """x.jsonl -> x.stats.json; any other name gets the suffix appended."""
    return dataset_path.removesuffix(".jsonl") + ".stats.json"


def save_stats(stats: DataFrame, dataset_path: str) -> str:
    path = stats_path(dataset_path)
    stats.write.mode("overwrite").json(path)
    return path


def load_stats(spark: SparkSession, dataset_path: str) -> dict[str, int]:
    path = stats_path(dataset_path)
    row = spark.read.json(path).first()
    found = row.asDict() if row else {}
    missing = sorted(set(REQUIRED) - set(found))
    if missing:
        raise ValueError(f"dataset stats {path} lack {', '.join(missing)}")
    stats = {name: int(value) for name, value in found.items()}
    if stats["partitions"] <= 0:
        raise ValueError(f"dataset stats {path} have partitions = {stats['partitions']}")
    return stats


def first_bids(bid: DataFrame, n: int) -> DataFrame:
    """The first ``n`` bids in time order; fails if there are fewer."""
    return take_first(bid, _BID_ORDER, n)


def replicate(keyed_rows: DataFrame, partitions: int, key: str = "key") -> DataFrame:
    """Lay a keyed log out for replay in even parts, of which there may be more than keys.

    With fewer keys than parts a key takes several of them, so no part grows with the rows of a key.
    """
    others = [c for c in keyed_rows.columns if c != key]
    return keyed_rows.repartition(partitions, key, *others)
