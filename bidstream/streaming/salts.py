"""Salts of stream joins from what is known of the keys, fixed for the life of a checkpoint."""

from pyspark.sql import SparkSession

from bidstream import workspace
from bidstream.operators.hot_keys import hot_keys, key_sketch
from bidstream.params import Params
from bidstream.sources.tables import Tables


def salted(p: Params, known: Tables, parts: int) -> Params:
    """``p`` with the hot keys of tables that are known before the stream starts, spread over ``parts``."""
    return p.but(
        join_salts=parts, hot_auctions=hot_keys(key_sketch(known.bid, "auction"), parts),
        hot_sellers=hot_keys(key_sketch(known.auction, "seller"), parts))


def remembered(spark: SparkSession, p: Params, checkpoint: str) -> Params:
    """The salts a checkpoint began with: state was dealt by them, so later runs keep to them."""
    path = f"{checkpoint}-salts"
    if workspace.exists(spark, f"{path}/_SUCCESS"):
        row = spark.read.json(path, schema="join_salts int, hot_auctions array<long>, hot_sellers array<long>").first()
        fixed = [None if keys is None else tuple(keys) for keys in (row.hot_auctions, row.hot_sellers)]
        return p.but(join_salts=row.join_salts, hot_auctions=fixed[0], hot_sellers=fixed[1])
    rows = [(p.join_salts, *(None if keys is None else list(keys) for keys in (p.hot_auctions, p.hot_sellers)))]
    spark.createDataFrame(rows, "join_salts int, hot_auctions array<long>, hot_sellers array<long>").coalesce(1).write.mode("overwrite").json(path)
    return p
