"""Row validation against a ``TableSpec``: typed rows on one side, quarantine on the other.

Everything is a column expression. Each row gets the list of everything that is wrong with
it, so it is valid or quarantined exactly once however many columns fail.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackside.functions.scalars import null_if_nan, parse_iso
from trackside.session import scratch_path
from trackside.specs import Field, TableSpec

ERRORS, TYPED, _BAD = "_errors", "_typed", "_bad"

# Texts accepted as flags.
TRUE_TEXTS = ["true", "t", "yes", "y", "on", "1"]
FALSE_TEXTS = ["false", "f", "no", "n", "off", "0"]


def _is_fraction(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))


def _present(column: Column, kind: T.DataType) -> Column:
    """The raw value with NaN read as NULL."""
    return null_if_nan(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def _to_long(raw: Column, kind: T.DataType, strict: bool) -> Column:
    if isinstance(kind, T.StringType):
        return F.trim(raw).try_cast("bigint")
    if _is_fraction(kind) and strict:
        return F.when(raw == F.floor(raw), raw.try_cast("bigint"))
    return raw.try_cast("bigint")


def _to_flag(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return raw
    text = F.lower(raw.cast("string")) if isinstance(kind, T.StringType) else raw.try_cast("bigint").cast("string")
    value = F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)
    return F.when(raw == F.floor(raw), value) if _is_fraction(kind) else value


def _to_time(raw: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return parse_iso(raw)
    if isinstance(kind, T.NumericType):
        return F.timestamp_micros((raw.cast("double") * 1_000_000).try_cast("bigint")).cast("timestamp_ntz")
    return raw.cast("timestamp_ntz")


def coerce(raw: Column, kind: T.DataType, target: T.DataType, strict: bool) -> Column:
    """The value as the target type, NULL where it cannot be read as one."""
    if isinstance(target, T.LongType):
        return _to_long(raw, kind, strict)
    if isinstance(target, T.DoubleType):
        return (F.trim(raw) if isinstance(kind, T.StringType) else raw).try_cast("double")
    if isinstance(target, T.BooleanType):
        return _to_flag(raw, kind)
    if isinstance(target, T.TimestampNTZType):
        return _to_time(raw, kind)
    if strict and not isinstance(kind, T.StringType):
        return F.lit(None).cast("string")
    return raw.cast("string")


def _check(field: Field, kind: T.DataType | None, strict: bool) -> tuple[Column, list[tuple[Column, str]]]:
    """The typed column of a field, and (condition, text) for everything that can be wrong with it."""
    name = field.name
    if kind is None:
        missing = [(F.lit(True), f"{name}: field required")] if strict and field.required else []
        return F.lit(None).cast(field.type), missing
    raw = _present(F.col(name), kind)
    value = coerce(raw, kind, field.type, strict)
    problems = []
    if kind != field.type:
        problems.append((raw.isNotNull() & value.isNull(), f"{name}: cannot be read as {field.type.simpleString()}"))
    if field.required:
        problems.append((raw.isNull(), f"{name}: {'field required' if strict else 'null in required column'}"))
    elif not strict and not field.nullable and isinstance(field.type, T.LongType):
        problems.append((raw.isNull(), f"{name}: null in integer column"))
    if field.between:
        low, high = field.between
        problems.append((F.coalesce(~value.between(low, high), F.lit(False)), f"{name}: outside [{low}, {high}]"))
    return value, problems


def _checks(df: DataFrame, spec: TableSpec) -> tuple[list[Column], list[tuple[Column, str]]]:
    strict = spec.mode == "contract"
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not strict:
        missing = [f.name for f in spec.fields if f.required and f.name not in kinds]
        if missing:
            raise ValueError(f"{spec.name}: required columns missing: {missing}")
    typed, problems = [], []
    for field in spec.fields:
        if field.name not in kinds and not (strict and field.required):
            continue
        value, found = _check(field, kinds.get(field.name), strict)
        typed.append(value.alias(field.name))
        problems.extend(found)
    return typed, problems


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The input rows plus ``_typed`` (struct of typed fields) and ``_errors`` (array of text)."""
    typed, problems = _checks(df, spec)
    texts = F.array(*[F.when(bad, F.lit(text)) for bad, text in problems]).cast("array<string>")
    return df.withColumns({TYPED: F.struct(*typed), ERRORS: F.array_compact(texts)})


@dataclass
class Validated:
    valid: DataFrame
    quarantine: DataFrame
    counts: Observation
    rejected: Observation

    def counters(self) -> dict[str, int]:
        """Rows read, valid and quarantined; available once ``valid`` has been written."""
        return self.counts.get


def split_valid(df: DataFrame, spec: TableSpec, reason: str) -> Validated:
    """Typed valid rows (extra columns kept) and raw quarantined rows with the reasons.

    Counters are observed while either side is written: no extra pass. The observation also
    keeps the checks in one place, evaluated once per row; error texts are built for
    quarantined rows only.
    """
    typed, problems = _checks(df, spec)
    counts, rejected = Observation(f"valid_{spec.name}"), Observation(f"quarantined_{spec.name}")
    bad = _any([condition for condition, _ in problems])
    is_bad = F.col(_BAD)
    names = {f.name for f in spec.fields}
    extra = [c for c in df.columns if c not in names]
    valid = (
        df.select(*typed, *extra, bad.alias(_BAD))
        .observe(
            counts,
            F.count(F.lit(1)).alias("read"),
            F.count_if(~is_bad).alias("valid"),
            F.count_if(is_bad).alias("quarantined"),
        )
        .where(~is_bad)
        .drop(_BAD)
    )
    quarantine = (
        df.withColumn(_BAD, bad)
        .observe(rejected, F.count_if(is_bad).alias("quarantined"))
        .where(is_bad)
        .select(
            *df.columns,
            F.concat_ws("; ", *[F.when(condition, F.lit(text)) for condition, text in problems]).alias("error_detail"),
            F.current_timestamp().cast("timestamp_ntz").alias("quarantine_timestamp"),
            F.lit(reason).alias("quarantine_reason"),
        )
    )
    return Validated(valid, quarantine, counts, rejected)


@dataclass
class Routed:
    """Both sides of a batch, read from where one pass over it has put them."""

    valid: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def route_valid(df: DataFrame, spec: TableSpec, reason: str) -> Routed:
    """The two sides of :func:`split_valid` from one evaluation of ``df``.

    Every row is written once, to the folder of its route: as typed columns if it is valid, as it came with the reasons
    if not. Both sides and the counters come from that; the batch is not read again.
    """
    typed, problems = _checks(df, spec)
    names, counts = {f.name for f in spec.fields}, Observation(f"routed_{spec.name}")
    bad = _any([condition for condition, _ in problems])
    is_bad = F.col(_BAD)
    kept = F.struct(*typed, *[c for c in df.columns if c not in names])
    why = F.concat_ws("; ", *[F.when(condition, F.lit(text)) for condition, text in problems])
    rows = df.select(F.struct(*df.columns).alias("raw"), kept.alias("kept"), why.alias("why"), bad.alias(_BAD)).observe(
        counts, F.count(F.lit(1)).alias("read"), F.count_if(~is_bad).alias("valid"), F.count_if(is_bad).alias("quarantined")
    )
    routed = rows.select(
        F.when(is_bad, F.col("raw")).alias("raw"), F.when(~is_bad, F.col("kept")).alias("kept"), F.when(is_bad, F.col("why")).alias("why"),
        F.when(is_bad, F.lit("quarantine")).otherwise(F.lit("valid")).alias("route"),
    )
    path = scratch_path(df.sparkSession, "routed")
    routed.write.partitionBy("route").parquet(path)
    stored = df.sparkSession.read.schema(routed.schema).parquet(path)
    quarantine = stored.where(F.col("route") == "quarantine").select(
        "raw.*", F.col("why").alias("error_detail"), F.current_timestamp().cast("timestamp_ntz").alias("quarantine_timestamp"),
        F.lit(reason).alias("quarantine_reason"),
    )
    return Routed(stored.where(F.col("route") == "valid").select("kept.*"), quarantine, counts.get)
