"""Data-quality rules counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import constants as K


def within(column: str, bounds: tuple[float, float]) -> Column:
    low, high = bounds
    return F.col(column).between(low, high)


def telemetry_rules() -> dict[str, Column]:
    """Physical limits of telemetry rows."""
    return {
        "speed_range": within("speed", K.SPEED_RANGE),
        "gear_range": within("n_gear", K.GEAR_RANGE),
        "rpm_range": within("rpm", K.RPM_RANGE),
    }


def quality_report(
    df: DataFrame,
    rules: dict[str, Column],
    *,
    table_rules: dict[str, Column] | None = None,
) -> DataFrame:
    """(rule, failing, total) with one row per rule from a single aggregate.

    A row fails a rule when its condition is false or NULL.
    ``table_rules`` are aggregate conditions, e.g. a mean inside a range; they fail for the
    whole table (failing = 1) or not at all. ``not_empty`` is always reported.
    """
    checks = {name: F.count_if(~F.coalesce(cond, F.lit(False))) for name, cond in rules.items()}
    for name, cond in {"not_empty": F.count(F.lit(1)) > 0, **(table_rules or {})}.items():
        checks[name] = F.when(F.coalesce(cond, F.lit(False)), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("failing")) for n in checks])
    return counted.select(F.explode(rows).alias("r"), "total").select("r.rule", "r.failing", "total")


def mean_within(column: str, bounds: tuple[float, float]) -> Column:
    return F.avg(column).between(*bounds)


def any_value(column: str) -> Column:
    """At least one value that is not NULL."""
    return F.count(column) > 0
