"""Reading, staging and blocking of tables for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidstream import workspace

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()

BLOCK_BYTES = 12 << 20
_BUCKETS = 32


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not see the driver's files."""
    if spark.sparkContext.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="bidstream-")) / "bidstream-sources.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted(_PACKAGE.rglob("*.py")):
            packed.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, purpose: str, keep: list | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: the lineage ends there.

    ``keep`` is the list of ``workspace.temporary``, for rows that outlive it.
    """
    spark = rows.sparkSession
    path = workspace.fresh(spark, purpose)
    if keep is not None:
        keep.append(path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def parts(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Shuffle partitions so that none gets much more than ``rows_per_part`` rows."""
    return max(1, spark.sparkContext.defaultParallelism, -(-rows // rows_per_part))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Documents dealt by hash into blocks of about ``block_bytes`` of text.

    Columns: block, doc (doc_id; null sorts last), th (hash of the text), data (the text as bytes)
    and rest (a struct of all columns but the text). A row's block depends on its id and text only.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(spark.sparkContext.defaultParallelism, -(-size // block_bytes))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int").alias("block"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.xxhash64("text").alias("th"),
        F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("data"),
        F.struct(*rest).alias("rest"),
    )
    return rows.repartition(count, "block"), count


def smallest(rows: DataFrame, order: list[Column], n: int, buckets: int = _BUCKETS) -> list:
    """The first ``n`` rows in ``order``, on the driver. At most ``n`` of each of ``buckets`` buckets of
    tasks get there, however many tasks there are."""
    bucket = rows.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    few = bucket.withColumn("_place", place).where(F.col("_place") <= n)
    return few.select(*rows.columns).orderBy(*order).limit(n).collect()
