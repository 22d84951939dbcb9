from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def side_input(spark: SparkSession, rows: int) -> DataFrame:
    """Keys 0 .. rows-1, each with its own text as the value."""
    return spark.range(rows).select(
        F.col("id").alias("key"), F.col("id").cast("string").alias("value")
    )
