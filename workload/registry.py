"""Named queries and the SQL each must agree with."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackside.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_folder(spark: SparkSession) -> SparkSession:
    """Where no shared folder is named, a session on one machine gets one there; the library itself has no fallback."""
    context = spark.sparkContext
    unnamed = not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir())
    if unnamed and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="workload-"))
    return spark


def query(oracle: str | None = None):
    """Register a function under its name."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(with_folder(configure(spark)), sf_dir)

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
