"""Shared folder for checkpoints, staged tables and streaming state."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="bidstream-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_made: list[str] = []


def fresh(spark: SparkSession, purpose: str) -> str:
    _made.append(f"{root(spark)}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Delete the folders that ``fresh`` has named in this process: no frame over them is read again."""
    while _made:
        delete(spark, _made.pop())


def _located(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def delete(spark: SparkSession, folder: str) -> None:
    system, path = _located(spark, folder)
    system.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    system, path = _located(spark, name)
    return system.exists(path)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders directly in a folder; none if it does not exist."""
    system, path = _located(spark, folder)
    return [found.getPath().getName() for found in system.listStatus(path)] if system.exists(path) else []


def read_text(spark: SparkSession, name: str) -> str:
    system, path = _located(spark, name)
    source = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A new small file that others see whole or not at all: drafted beside its place, then renamed."""
    system, path = _located(spark, name)
    draft = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if system.exists(path) or not system.rename(draft, path):
        system.delete(draft, False)
        raise FileExistsError(name)


@contextmanager
def temporary(spark: SparkSession):
    """Folders that ``fresh`` names inside are deleted at the end, but those added to the yielded list."""
    start, keep = len(_made), []
    try:
        yield keep
    finally:
        inside = _made[start:]
        _made[start:] = [folder for folder in inside if folder in keep]
        for folder in inside:
            if folder not in keep:
                delete(spark, folder)


@contextmanager
def held(rows: DataFrame):
    """The rows as their last shuffle has laid them out, for several readings inside the context.

    The files of the shuffle serve all readings and are deleted at the end; unlike ``frozen`` nothing is written
    besides them. A lost part of them is made again from the source, with the bounds of the first time. So that
    every reading finds the same rows in a partition, the shuffle must place a row by its columns alone.
    """
    spark = rows.sparkSession
    laid_out = rows._jdf.queryExecution().toRdd()
    try:
        yield DataFrame(spark._jsparkSession.internalCreateDataFrame(laid_out, rows._jdf.schema(), False), spark)
    finally:
        laid_out.cleanShuffleDependencies(False)


def frozen(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are stored in the shared folder and their lineage is cut."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root(spark))
    return rows.checkpoint(eager=True)
