"""The three flat tables, and how to derive them from an order warehouse."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables(NamedTuple):
    bid: DataFrame
    auction: DataFrame | None = None
    person: DataFrame | None = None


# The columns read, so that opening a table needs no look into its files.
_WAREHOUSE = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_returnflag STRING, l_linestatus STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
}
_SPAN = 255_600  # seconds over which auctions open


def stored_bytes(spark: SparkSession, directory: str) -> int:
    """Size of the warehouse tables on storage, from file metadata only."""
    paths = [f"{directory}/{name}.parquet" for name in _WAREHOUSE]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg(F.sum("length")).first()[0] or 0


def _moment(seconds):
    # Plain arithmetic on the epoch: no session time zone takes part.
    return F.timestamp_seconds(F.lit(1_704_067_200) + seconds.cast("long"))  # 2024-01-01 UTC


def from_warehouse(spark: SparkSession, directory: str) -> Tables:
    """Views over line items (as bids), orders (as auctions) and customers (as people)."""

    def table(name):
        return spark.read.schema(_WAREHOUSE[name]).parquet(f"{directory}/{name}.parquet")

    return Tables(
        bid=bids_of(table("lineitem")),
        auction=auctions_of(table("orders")),
        person=people_of(table("customer")),
    )


def bids_of(lineitem: DataFrame) -> DataFrame:
    order, part, supplier, line = (
        F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
    offset = (order * 17) % _SPAN + (part * 7919 + supplier * 13 + line * 61) % 7200 - 600
    kind = part % 8
    channel = (
        F.when(kind == 0, "Apple").when(kind == 1, "Google")
        .when(kind == 2, "Facebook").when(kind == 3, "Baidu")
        .otherwise(F.concat(F.lit("channel-"), part % 100))
    )
    url = F.concat(
        F.lit("https://www.example.com/d"), supplier % 7, F.lit("/e"), part % 5,
        F.lit("/f"), line, F.lit("/item.htm?query=1"),
        F.when(part % 3 != 0, F.concat(F.lit("&channel_id="), supplier)).otherwise(""),
    )
    return lineitem.select(
        _moment(offset).alias("ts"),
        order.alias("auction"),
        part.alias("bidder"),
        (F.floor("l_extendedprice").cast("bigint") * F.col("l_quantity").cast("bigint")).alias("price"),
        channel.alias("channel"),
        url.alias("url"),
        F.concat("l_returnflag", F.repeat(F.lit("c"), line), "l_linestatus").alias("extra"),
    )


def auctions_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    opens = (key * 17) % _SPAN
    return orders.select(
        key.alias("id"),
        F.concat(F.lit("item-"), key).alias("item_name"),
        F.col("o_orderpriority").alias("description"),
        F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("initial_bid"),
        F.floor(F.col("o_totalprice") / 50).cast("bigint").alias("reserve"),
        _moment(opens).alias("date_time"),
        _moment(opens + 1800 + key % 1800).alias("expires"),
        F.col("o_custkey").alias("seller"),
        (F.lit(10) + key % 5).cast("bigint").alias("category"),
        F.col("o_orderstatus").alias("extra"),
    )


def people_of(customer: DataFrame) -> DataFrame:
    nation = F.col("c_nationkey")
    state = F.lit("wy")
    for rest, name in reversed(list(enumerate(("or", "id", "ca", "wa", "az")))):
        state = F.when(nation % 6 == rest, name).otherwise(state)
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("email_address"),
        F.lit(None).cast("string").alias("credit_card"),
        F.concat(F.lit("city-"), nation).alias("city"),
        state.alias("state"),
        _moment((F.col("c_custkey") * 173) % 259_200).alias("date_time"),
        F.col("c_mktsegment").alias("extra"),
    )
