"""As-of join: for each left row the latest right row of the same key at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackside.functions.scalars import micros
from trackside.operators.joins import all_not_null

BUCKET_SECONDS = 3600.0
_TIME, _SIDE, _LEFT, _RIGHT, _BUCKET = "_time", "_side", "_left", "_right", "_bucket"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    on: str,
    right_on: str | None = None,
    right_cols: list[str] | dict[str, str] | None = None,
    tie_break: list[str] | None = None,
    how: str = "inner",
    bucket_seconds: float = BUCKET_SECONDS,
) -> DataFrame:
    """Backward, inclusive as-of join.

    Both sides are laid on one time line per key and a running "last right row" is read
    off at each left row, instead of a join. Right rows travel as
    a struct, so that NULL fields inside a right row are kept. Among right rows of one
    instant the greatest ``tie_break`` wins, by default all right columns in turn. NULL keys
    and times never match; such left rows are kept by ``left`` and left out by ``left_keyed``.

    A task has one key's rows of ``bucket_seconds``, so a key of any size is spread over tasks. The last right row
    of each bucket is carried forward over a table of one row per key and bucket. The plan is the same for
    any amount of data; dense series want shorter buckets, sparse ones longer. Rows of one key at one
    instant stay together.
    """
    if how not in ("inner", "left", "left_keyed"):
        raise ValueError(f"how must be 'inner', 'left' or 'left_keyed', not {how!r}")
    right_on = right_on or on
    if right_cols is None:
        right_cols = [c for c in right.columns if c not in (*by, right_on)]
    tie_break = list(right_cols) if tie_break is None else tie_break
    renames = right_cols if isinstance(right_cols, dict) else {c: c for c in right_cols}
    clash = set(renames.values()) & set(left.columns)
    if clash:
        raise ValueError(f"right columns also on the left, rename them: {sorted(clash)}")

    usable_left, usable_right = all_not_null([*by, on]), all_not_null([*by, right_on])
    # Keys and times travel as columns of their own; only the rest is packed.
    packed = [c for c in left.columns if c not in (*by, on)]
    extra_ties = [c for c in tie_break or [] if c not in renames]
    payload = [F.col(c).alias(name) for c, name in renames.items()] + [F.col(c).alias(f"_tie_{c}") for c in extra_ties]
    ties = [f"{_RIGHT}.{renames.get(c, f'_tie_{c}')}" for c in tie_break or []]

    right_side = right.where(usable_right).select(
        *by, F.col(right_on).alias(_TIME), F.lit(0).alias(_SIDE), F.struct(*(payload or [F.lit(0)])).alias(_RIGHT)
    )
    left_side = left.where(usable_left).select(
        *by, F.col(on).alias(_TIME), F.lit(1).alias(_SIDE), F.struct(*(packed or [F.lit(0)])).alias(_LEFT)
    )
    bucket = F.floor(micros(F.col(_TIME)) / F.lit(round(bucket_seconds * 1e6))).alias(_BUCKET)
    keys = [*by, _BUCKET]
    # Both readers of the line ask for all of its columns, so that they share one exchange and each side is read once.
    line = left_side.unionByName(right_side, allowMissingColumns=True).withColumn(_BUCKET, bucket).repartition(*keys)
    newest = F.max_by(_RIGHT, F.when(F.col(_SIDE) == 0, F.struct(_TIME, *ties)))
    per_bucket = line.groupBy(*keys).agg(newest.alias("_newest"), F.count(_LEFT).alias("_asked"))
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # The newest right row of all buckets before, for the buckets with left rows.
    carried = (
        per_bucket.withColumn("_carried", F.last("_newest", ignorenulls=True).over(earlier))
        .where((F.col("_asked") > 0) & F.col("_carried").isNotNull())
        .select(*keys, "_carried")
    )
    running = (
        Window.partitionBy(*keys)
        .orderBy(F.asc_nulls_first(_TIME), _SIDE, *[F.asc_nulls_first(t) for t in ties])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = (
        line.withColumn("_own", F.last(_RIGHT, ignorenulls=True).over(running))
        .where(F.col(_SIDE) == 1)
        .join(carried, keys, "left")
        .withColumn("_match", F.coalesce("_own", "_carried"))
    )
    own = [F.col(_TIME if c == on else c if c in by else f"{_LEFT}.{c}").alias(c) for c in left.columns]
    fields = [F.col(f"_match.{name}").alias(name) for name in renames.values()]
    if how == "inner":
        return matched.where(F.col("_match").isNotNull()).select(*own, *fields)
    if how == "left_keyed":
        return matched.select(*own, *fields)
    unmatched = left.where(~usable_left)
    return matched.select(*own, *fields).unionByName(unmatched, allowMissingColumns=True)

