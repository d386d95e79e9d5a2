"""Raw record batches: landing, reading back and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.functions.scalars import int_or_zero, path_token
from trackside.sources import files
from trackside.sources.lakehouse import replace_partitions
from trackside.sources.schemas import read_reconciled

PARTITION = ["year", "gp", "session"]

# Columns that mix numbers and text in the raw records, stored as text.
MIXED_COLUMNS = ["gap_to_leader", "interval"]
COORDINATES = ["x", "y", "z"]


def stringify_mixed(df: DataFrame, columns: list[str] = MIXED_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def coerce_numbers(df: DataFrame, columns: list[str] = COORDINATES) -> DataFrame:
    """Unreadable and missing numbers become 0."""
    return df.withColumns({c: int_or_zero(F.col(c)) for c in columns if c in df.columns})


def bronze_path(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/bronze/{kind}"


def land_bronze(
    df: DataFrame, root: str, kind: str, year: int | Column, gp: str | Column, session: str | Column
) -> str:
    """Write a batch of a record kind to its season / event / session partitions.

    Each key is a value for the whole batch or a column, so that one job lands many sessions.
    """
    path = bronze_path(root, kind)
    given = {"_year": year, "_gp": gp, "_session": session}
    df = df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items()})
    tokens = {k: path_token(F.col(f"_{k}").cast("string")) for k in PARTITION}
    raw = stringify_mixed(df)
    if kind == "location":
        raw = coerce_numbers(raw)
    # A raw column named like a partition key moves aside; ``read_bronze`` moves it back.
    raw = raw.withColumnsRenamed({c: f"raw_{c}" for c in PARTITION if c in raw.columns})
    replace_partitions(raw.withColumns(tokens).drop(*given), path, PARTITION)
    return path


def _batches(root: str, kind: str, year: int | None, gp: str | None, session: str | None) -> str:
    given = zip(PARTITION, (year, gp, session))
    folders = [f"{k}={'*' if v is None else str(v).replace(' ', '_')}" for k, v in given]
    return "/".join([bronze_path(root, kind), *folders])


def has_bronze(
    spark: SparkSession,
    root: str,
    kind: str,
    year: int | None = None,
    gp: str | None = None,
    session: str | None = None,
) -> bool:
    return files.matches(spark, _batches(root, kind, year, gp, session))


def read_bronze(
    spark: SparkSession,
    root: str,
    kind: str,
    year: int | None = None,
    gp: str | None = None,
    session: str | None = None,
) -> DataFrame:
    """The partitions asked for; their keys are ``_year``, ``_gp`` and ``_session``.

    Only the folders named are listed. A partition is one batch, so one footer of each tells its types; columns
    that changed type from batch to batch are read as the type all agree on.
    """
    batches = files.matching(spark, _batches(root, kind, year, gp, session))
    if not batches:
        raise FileNotFoundError(f"no {kind} batches at {_batches(root, kind, year, gp, session)}")
    found = read_reconciled(spark, batches, bronze_path(root, kind))
    keyed = found.withColumnsRenamed({k: f"_{k}" for k in PARTITION})
    return keyed.withColumnsRenamed({f"raw_{k}": k for k in PARTITION if f"raw_{k}" in found.columns})


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One plan over many per-driver files, whatever the types of their columns."""
    return read_reconciled(spark, paths)


def write_quarantine(df: DataFrame, root: str, kind: str) -> None:
    """Bad rows, replacing what earlier runs quarantined for the same partitions."""
    path = f"{root.rstrip('/')}/quarantine/{kind}_corrupt"
    keys = [f"_{k}" for k in PARTITION]
    named = df.withColumnsRenamed({k: f"raw_{k}" for k in PARTITION if k in df.columns})
    replace_partitions(named.withColumnsRenamed(dict(zip(keys, PARTITION))), path, PARTITION)
