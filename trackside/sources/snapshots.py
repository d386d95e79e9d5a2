"""Tables published as versions: a reader keeps the version it opened, and of two writers on one version only one commits.

``path/data-<id>`` holds the files of a version, written before anybody can see them. ``path/_versions/<number>`` names that
folder; a version exists from the moment its file is renamed into place, which fails where the number is taken. Nothing
that is read is ever moved or overwritten: old versions stay until ``expire``. Renaming without overwriting is atomic on
file systems such as HDFS; on others two commits within the same instant need a lock of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackside.sources import files

ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another writer has committed on the same base version."""


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/_versions"


def _entry(path: str, version: int) -> str:
    return f"{_log(path)}/{version:012d}"


def current(spark: SparkSession, path: str) -> int:
    """The newest version; 0 where nothing has been published."""
    return max((int(name) for name in files.names(spark, _log(path)) if name.isdigit()), default=0)


def folder_of(spark: SparkSession, path: str, version: int) -> str:
    if not files.exists(spark, _entry(path, version)):
        raise ValueError(f"{path} has no version {version}")
    return f"{path.rstrip('/')}/{files.read_text(spark, _entry(path, version))}"


def commit(spark: SparkSession, df: DataFrame, path: str, base: int) -> int:
    """Publish ``df``, made from version ``base``, as the next one; ``Conflict`` where that number is taken meanwhile."""
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    if not files.create_once(spark, _entry(path, base + 1), name):
        files.delete_folder(spark, f"{path.rstrip('/')}/{name}")
        raise Conflict(f"version {base + 1} of {path} is already there")
    return base + 1


def update(spark: SparkSession, path: str, make: Callable[[str | None], DataFrame], attempts: int = ATTEMPTS) -> int:
    """Publish ``make(folder of the newest version)``; after a conflict it is made again from what the other has published."""
    for attempt in range(attempts):
        base = current(spark, path)
        try:
            return commit(spark, make(folder_of(spark, path, base) if base else None), path, base)
        except Conflict:
            if attempt + 1 == attempts:
                raise
    raise ValueError("attempts must be positive")


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` versions, for times without readers of older ones; returns how many went."""
    newest = current(spark, path)
    old = sorted(int(n) for n in files.names(spark, _log(path)) if n.isdigit() and int(n) <= newest - keep)
    for version in old:
        files.delete_folder(spark, folder_of(spark, path, version))
        files.delete_files(spark, [_entry(path, version)])
    return len(old)
