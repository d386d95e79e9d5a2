"""Row numbers per key and systematic down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside.functions.scalars import micros
from trackside.operators.joins import null_safe_join


def order_number(df: DataFrame, column: str) -> Column:
    """The order column as a number; times in microseconds, dates in days."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(F.col(column))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(column)).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.col(column)
    raise ValueError(f"{column} is no number or time, it can not be cut into buckets")


def rank_rows(
    df: DataFrame, *, by: list[str], order: list[str], widths: list[float] | None = None, totals: bool = True
) -> DataFrame:
    """Add ``rn`` (1-based position in its key) and, with ``totals``, ``n`` (rows of the key).

    Without ``widths`` a key is numbered by one task. With them, keys of any size are spread over tasks: the first
    order column is cut into buckets as wide as the first of ``widths`` (microseconds for times), each bucket by the second
    order column and width, and so on. So rows tied in the first column are spread along the second, if both have a
    width. Each level numbers inside its pieces and adds the rows of the pieces before, from a table of one row per piece.
    """
    key = Window.partitionBy(*by)
    ordered = [F.asc_nulls_last(c) for c in order]
    if not widths:
        return df.withColumns(
            {"rn": F.row_number().over(key.orderBy(*ordered)).cast("bigint"), "n": F.count(F.lit(1)).over(key)}
        )
    if len(widths) > len(order):
        raise ValueError("more widths than order columns")
    # Below the first level a piece is one value of the columns before: only those, not wider buckets, keep the order.
    levels: list[str] = []
    for i, width in enumerate(widths):
        if i:
            levels.append(f"_exact{i - 1}")
            df = df.withColumn(levels[-1], order_number(df, order[i - 1]))
        levels.append(f"_bucket{i}")
        df = df.withColumn(levels[-1], F.floor(order_number(df, order[i]) / F.lit(width)))
    piece = Window.partitionBy(*by, *levels)
    numbered = df.withColumn("rn", F.row_number().over(piece.orderBy(*ordered)).cast("bigint"))
    sizes = df.groupBy(*by, *levels).agg(F.count(F.lit(1)).alias("_size"))
    # From the innermost level outwards: rows before a piece within the next wider one, then the wider ones.
    before = F.lit(0).cast("bigint")
    placed = numbered
    for depth in range(len(levels), 0, -1):
        outer, level = levels[: depth - 1], levels[depth - 1]
        step = f"_before{depth}"
        window = Window.partitionBy(*by, *outer).orderBy(F.asc_nulls_last(level))
        table = sizes.groupBy(*by, *levels[:depth]).agg(F.sum("_size").alias("_size")).withColumn(
            step, F.coalesce(F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        placed = null_safe_join(placed, table.drop("_size"), [*by, *levels[:depth]], "inner")
        before = before + F.col(step)
    if totals:
        rows = sizes.groupBy(*by).agg(F.sum("_size").alias("n"))
        placed = null_safe_join(placed, rows, by, "inner") if by else placed.withColumn("n", rows.scalar())
    dropped = [*levels, *[f"_before{d}" for d in range(1, len(levels) + 1)]]
    return placed.withColumn("rn", F.col("rn") + before).drop(*dropped)


def downsample(
    df: DataFrame,
    *,
    by: list[str],
    order: list[str],
    target: int,
    rounding: str = "half_even",
    cap: int | None = None,
    size: str | None = None,
    widths: list[float] | None = None,
) -> DataFrame:
    """Keep every step-th row of each key, about ``target`` rows; adds ``rn``.

    ``half_even`` rounds the step (1 up to ``target`` rows), ``floor`` cuts it off. ``cap``
    bounds the rows kept per key, in order. ``size`` names a column to take the key's row
    count from instead of counting the rows given. ``widths``: see :func:`rank_rows`.
    """
    ranked = rank_rows(df, by=by, order=order, widths=widths, totals=size is None)
    if size is not None:
        ranked = ranked.withColumn("n", F.col(size))
    ratio = F.col("n") / F.lit(float(target))
    if rounding == "half_even":
        step = F.when(F.col("n") > target, F.rint(ratio).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    elif rounding == "floor":
        step = F.greatest(F.lit(1).cast("bigint"), F.floor(ratio))
    else:
        raise ValueError(f"unknown rounding {rounding!r}")
    kept = ranked.withColumn("_step", step).where(F.col("rn") % F.col("_step") == 0)
    if cap is not None:
        kept = kept.where(F.col("rn") / F.col("_step") <= cap)
    return kept.drop("_step", "n")
