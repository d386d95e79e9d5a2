"""Whole-table operators: upsert, de-duplication, latest rows, fallbacks, unions, range expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import constants as K
from trackside.operators.joins import null_safe_join

RANGE_BLOCK = 4096


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key is not in ``new``, plus all of ``new``; NULL keys match NULL keys."""
    return union_all([null_safe_join(existing, new.select(*keys).distinct(), keys, "left_anti"), new])


def first_rows(df: DataFrame, keys: list[str], order: list[str], *, descending: bool = False) -> DataFrame:
    """One row per key: the first in ``order`` (the last with ``descending``).

    An aggregate with map-side combine, so a key with very many copies costs one row per
    input task. NULL order values come last in either direction.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank: list[Column] = []
    for c in order:
        rank += [F.col(c).isNotNull() if descending else F.col(c).isNull(), F.col(c)]
    pick = F.max_by if descending else F.min_by
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        pick(row, F.struct(*rank)).alias("_row")
    ).select("_row.*")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_rows(df, keys, order)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_rows(df, keys, order, descending=True)


def match_or_all(df: DataFrame, predicate: Column, by: list[str]) -> DataFrame:
    """Per group, the rows matching ``predicate``; every row where the group has no match.

    Adds ``matched``, whether the group had a match.
    """
    flagged = df.withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    groups = flagged.groupBy(*by).agg(F.max("_hit").alias("matched"))
    return (
        null_safe_join(flagged, groups, by, "inner").where(F.col("_hit") | ~F.col("matched")).drop("_hit")
    )


def expand_range(
    df: DataFrame,
    start: str,
    end: str,
    *,
    index: str,
    value: str,
    open_length: int = K.OPEN_STINT_LAPS,
    repair_length: int = K.INVERTED_STINT_LAPS,
) -> DataFrame:
    """One row per integer of ``[start, end]``, with its 0-based ``index``.

    A missing end becomes start + ``open_length``; an end before the start becomes
    start + ``repair_length``. The end is repaired first: a descending sequence would
    otherwise count down. A row without a start stays, with NULL index and value. Long ranges are expanded block by block, so that no row has to hold
    its whole range in memory.
    """
    first = F.col(start).cast("bigint")
    last = F.coalesce(F.col(end).cast("bigint"), first + open_length)
    last = F.when(last < first, first + repair_length).otherwise(last)
    block_end = F.least(F.col("_block") + (RANGE_BLOCK - 1), F.col("_last"))
    return (
        df.withColumn("_last", last)
        .withColumn("_block", F.explode_outer(F.sequence(first, F.col("_last"), F.lit(RANGE_BLOCK).cast("bigint"))))
        .withColumn(value, F.explode_outer(F.sequence(F.col("_block"), block_end)))
        .withColumn(index, F.col(value) - first)
        .drop("_last", "_block")
    )
