"""A folder that a stream adds to for months: parts, merged in levels and read by manifest.

Every commit writes the next manifest, ``_manifest/<version>.json``, a complete list of the parts in use.
It is drafted under another name and renamed, so a reader sees the old list or the new one. Rows belong to
the store only once a manifest names their part: a writer stopped anywhere leaves the last commit as it is,
and what it left over is deleted after a later one.

With ``merge``, ``fan`` parts of a level become one part of the next level in the micro-batch that fills it.
A part holds what ``merge`` leaves, say a row per key, so n micro-batches keep fewer than
``fan * log(n, fan)`` rows per key, and each row is rewritten ``log(n, fan)`` times. Without ``merge`` rows
are only added, and the list grows by a part per micro-batch.

A store has one writer, the query whose id its manifest holds. Frames over it stay readable for
``KEPT_VERSIONS`` more commits.
"""

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from bidstream import workspace

KEPT_VERSIONS = 16


class Part(NamedTuple):
    folder: str
    level: int


class Manifest(NamedTuple):
    version: int = 0
    owner: str | None = None
    last: int = -1  # the newest micro-batch in the parts
    parts: tuple[Part, ...] = ()


def current(spark: SparkSession, path: str) -> Manifest:
    versions = _versions(spark, path)
    return _manifest(spark, path, max(versions)) if versions else Manifest()


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of the store as of now; none if nothing has been committed."""
    return _rows(spark, path, current(spark, path).parts, schema)


def add(
    rows: DataFrame, batch_id: int, path: str, owner: str | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None, fan: int = 8, replace: bool = False,
    versions: int = KEPT_VERSIONS,
) -> None:
    """Commit a micro-batch once, in place of all parts if ``replace``, then merge the levels it fills.

    Frames over the store stay readable for ``versions`` more commits."""
    if fan < 2:
        raise ValueError("a level is merged from at least 2 parts")
    spark = rows.sparkSession
    now = current(spark, path)
    if None not in (owner, now.owner) and owner != now.owner:
        raise ValueError(f"{path} holds the rows of query {now.owner}")
    if batch_id <= now.last:
        # Retried after its commit: the state of the query still has to take the step.
        rows.write.format("noop").mode("overwrite").save()
        return
    held = () if replace else now.parts
    now = Manifest(now.version, now.owner or owner, batch_id, (*held, _written(rows, path, 0)))
    now = _commit(spark, path, now)
    if merge is not None:
        _merge_levels(spark, path, now, rows.schema, merge, fan)
    _tidy(spark, path, versions)


def _merge_levels(spark, path, now, schema, merge, fan):
    level = 0
    while len(full := [part for part in now.parts if part.level == level]) >= fan:
        merged = merge(_rows(spark, path, full, schema)).select(*schema.names)
        others = tuple(part for part in now.parts if part.level != level)
        now = now._replace(parts=(*others, _written(merged, path, level + 1)))
        now = _commit(spark, path, now)
        level += 1


def _written(rows: DataFrame, path: str, level: int) -> Part:
    folder = f"part={uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    return Part(folder, level)


def _rows(spark, path, parts, schema) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{part.folder}" for part in parts])


def _versions(spark, path) -> list[int]:
    names = workspace.names(spark, f"{path}/_manifest")
    return [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[0] != "."]


def _name(path, version) -> str:
    return f"{path}/_manifest/{version:012d}.json"


def _manifest(spark, path, version) -> Manifest:
    found = json.loads(workspace.read_text(spark, _name(path, version)))
    parts = tuple(Part(*part) for part in found["parts"])
    return Manifest(version, found["owner"], found["last"], parts)


def _commit(spark, path, now: Manifest) -> Manifest:
    following = now._replace(version=now.version + 1)
    body = {"owner": following.owner, "last": following.last, "parts": following.parts}
    workspace.write_text(spark, _name(path, following.version), json.dumps(body))
    return following


def _tidy(spark, path, most) -> None:
    """Delete old manifests, and the parts that none of the kept ones names."""
    versions = sorted(_versions(spark, path))
    for version in versions[:-most]:
        workspace.delete(spark, _name(path, version))
    kept = [_manifest(spark, path, version) for version in versions[-most:]]
    named = {part.folder for manifest in kept for part in manifest.parts}
    for folder in workspace.names(spark, path):
        if folder.startswith("part=") and folder not in named:
            workspace.delete(spark, f"{path}/{folder}")
