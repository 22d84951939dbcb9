from pyspark.sql import SparkSession

from bidstream.session import configure

_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    # State larger than executor memory, and checkpoints that upload changes only.
    "spark.sql.streaming.stateStore.providerClass": _STATE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Session windows: merge what one task can merge before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
}


def configure_streaming(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
