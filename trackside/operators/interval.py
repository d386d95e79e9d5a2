"""Aggregates of a series over the time window that each event opens."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackside.functions.scalars import micros
from trackside.operators.joins import all_not_null


@dataclass(frozen=True)
class Measure:
    """One output column: ``how`` is avg, sum, min, max or count (rows, column ignored)."""

    name: str
    how: str
    column: str | None = None



def interval_aggregate(
    events: DataFrame,
    series: DataFrame,
    *,
    by: list[str],
    event_ts: str,
    series_ts: str,
    measures: list[Measure],
    after_seconds: float,
    before_seconds: float = 0.0,
    how: str = "left",
    few_events: bool = False,
    slices: int = 1,
) -> DataFrame:
    """Join each event with measures over series rows of its key in ``[t - before, t + after]``.

    No (event, series) pair is ever built. Time is cut into buckets as wide as the window,
    so a window covers the tail of one bucket and the head of the next. Running aggregates
    per bucket, one forwards and one backwards, give both parts in a single pass. Series
    rows of one instant are combined before the shuffle, events of one instant are computed
    once. With ``by=[]`` all rows belong together and the time buckets distribute the work.

    For dense data, series or events, ``slices`` cuts a window into so many buckets (its length in microseconds
    must be a multiple); the whole buckets inside a window are then summed up by the same method one level
    up, over one row per bucket and once for all windows that begin in the same bucket.

    ``how="inner"`` drops events without any series row. ``few_events`` says that the events
    are few: series rows in buckets that nobody asks for are dropped first, by a semi join
    for which Spark may broadcast the keys and buckets asked for.
    """
    before, width = round(before_seconds * 1e6), round((before_seconds + after_seconds) * 1e6)
    if width <= 0:
        raise ValueError("the window must have a length")
    parts = _parts(measures)
    merge = {name: getattr(F, fn) for name, (fn, _) in parts.items()}

    at = micros(F.col(series_ts))
    timed = series.where(all_not_null([*by, series_ts])).withColumn("_at", at)
    if slices < 1 or width % slices:
        raise ValueError("slices must divide the window's length in microseconds")
    grain = width // slices
    timed = timed.withColumn("_bucket", F.floor(F.col("_at") / F.lit(grain)))

    opened = micros(F.col(event_ts)) - F.lit(before)
    windows = (
        events.where(all_not_null([*by, event_ts]))
        .select(*by, opened.alias("_opened"))
        .distinct()
        .withColumn("_from", F.floor(F.col("_opened") / F.lit(grain)))
    )
    if few_events:
        reach = F.explode(F.sequence("_from", F.col("_from") + slices)).alias("_bucket")
        timed = timed.join(windows.select(*by, reach).distinct(), [*by, "_bucket"], "left_semi")
    instants = timed.groupBy(*by, "_bucket", "_at").agg(*[e.alias(n) for n, (_, e) in parts.items()])

    pieces = [
        _edges(
            instants,
            windows,
            by,
            merge,
            starts={"_at": F.col("_opened"), "_bucket": F.col("_from")},
            ends={"_at": F.col("_opened") + width, "_bucket": F.col("_from") + slices},
        )
    ]
    if slices > 1:
        # Whole buckets first..last inside the window, in blocks of as many buckets.
        inner = slices - 1
        first, last = F.col("_from") + 1, F.col("_from") + inner
        block = lambda bucket: F.floor(bucket / F.lit(inner))
        buckets = (
            instants.groupBy(*by, F.col("_bucket").alias("_at"))
            .agg(*[fn(name).alias(name) for name, fn in merge.items()])
            .withColumn("_bucket", block(F.col("_at")))
        )
        # Depends on the bucket a window begins in alone, so dense events cost no more than one window a bucket.
        begun = windows.select(*by, F.col("_from").alias("_opened"), "_from").distinct()
        whole = _edges(
            buckets,
            begun,
            by,
            merge,
            starts={"_at": first, "_bucket": block(first)},
            ends={"_at": last, "_bucket": block(last)},
            # A run that starts with its block is that block: its tail says everything.
            needs_end=first % inner != 0,
        )
        whole = whole.groupBy(*by, F.col("_opened").alias("_from")).agg(*[fn(name).alias(name) for name, fn in merge.items()])
        pieces.append(windows.join(whole, [*by, "_from"]).select(*by, "_opened", *merge))
    summed = (
        reduce(lambda a, b: a.unionByName(b), pieces)
        .groupBy(*by, "_opened")
        .agg(*[fn(name).alias(name) for name, fn in merge.items()])
        .where(F.col("_rows") > 0)
    )
    return (
        events.withColumn("_opened", opened)
        .join(summed, [*by, "_opened"], how)
        .select(*[F.col(c) for c in events.columns], *[_output(m) for m in measures])
    )


def _parts(measures: list[Measure]) -> dict[str, tuple[str, Column]]:
    """Partial aggregates needed: name -> (function that merges it, expression over rows)."""
    parts = {"_rows": ("sum", F.count(F.lit(1)))}
    for m in measures:
        if m.how not in ("avg", "sum", "min", "max", "count"):
            raise ValueError(f"unknown measure {m.how!r}")
        if m.how in ("avg", "sum"):
            parts[f"_sum_{m.column}"] = ("sum", F.sum(m.column))
        if m.how == "avg":
            parts[f"_cnt_{m.column}"] = ("sum", F.count(m.column))
        if m.how in ("min", "max"):
            parts[f"_{m.how}_{m.column}"] = (m.how, getattr(F, m.how)(m.column))
    return parts


def _output(m: Measure) -> Column:
    if m.how == "count":
        value = F.coalesce(F.col("_rows"), F.lit(0))
    elif m.how == "avg":
        count = F.col(f"_cnt_{m.column}")
        value = F.col(f"_sum_{m.column}") / F.when(count > 0, count)
    else:
        value = F.col(f"_{m.how}_{m.column}")
    return value.alias(m.name)


def _edges(
    rows: DataFrame,
    windows: DataFrame,
    by: list[str],
    merge: dict,
    starts: dict[str, Column],
    ends: dict[str, Column],
    needs_end: Column | None = None,
) -> DataFrame:
    """(by, ``_opened``, parts): what ``rows`` add up to from each start to the end of its bucket,
    and from the beginning of each end's bucket to that end; two rows per window."""
    points = F.array(
        F.struct(F.lit(1).alias("_point"), *[c.alias(n) for n, c in starts.items()]),
        F.when(
            F.lit(True) if needs_end is None else needs_end,
            F.struct(F.lit(2).alias("_point"), *[c.alias(n) for n, c in ends.items()]),
        ),
    )
    marks = windows.select(*by, "_opened", F.explode(points).alias("_p")).where(F.col("_p").isNotNull())
    line = marks.select(*by, "_opened", "_p.*").unionByName(
        rows.withColumn("_point", F.lit(0)), allowMissingColumns=True
    )
    group = Window.partitionBy(*by, "_bucket")
    frame = (Window.unboundedPreceding, Window.currentRow)
    head = group.orderBy(F.asc("_at")).rangeBetween(*frame)
    tail = group.orderBy(F.desc("_at")).rangeBetween(*frame)
    heads = line.withColumns({f"h{name}": fn(name).over(head) for name, fn in merge.items()})
    both = heads.withColumns({f"t{name}": fn(name).over(tail) for name, fn in merge.items()})
    chosen = [
        F.when(F.col("_point") == 1, F.col(f"t{name}")).otherwise(F.col(f"h{name}")).alias(name) for name in merge
    ]
    return both.where(F.col("_point") > 0).select(*by, "_opened", *chosen)
