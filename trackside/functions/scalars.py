"""Column expressions shared by operators and plans. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackside import constants as K


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (the session zone is UTC, see ``session.SETTINGS``)."""
    return F.unix_micros(ts.cast("timestamp"))


def iso_micros(ts: Column) -> Column:
    """ISO-8601 text with six fractional digits."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp without zone; offsets are honoured, bad text is NULL.

    A plain cast to ``timestamp_ntz`` would drop the offset, so the text is read as
    an instant first.
    """
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def parse_with_format(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def int_or_zero(value: Column) -> Column:
    """Numeric coercion where anything unreadable becomes 0; fractions are truncated."""
    text = value.cast("string")
    # Whole numbers first: beyond 2**53 a double would change them.
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive literal containment; NULL counts as no match."""
    return F.coalesce(F.lower(column).contains(needle.lower()), F.lit(False))


def clean_gear(gear: Column) -> Column:
    low, high = K.GEAR_RANGE
    return F.when(gear.between(low, high), gear).otherwise(F.lit(0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def pct_true(condition: Column) -> Column:
    """Share of rows in percent; NULL conditions count as false."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))) * F.lit(100.0)


def lookup(value: Column, table: dict, default) -> Column:
    """Small fixed table as a literal map."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[value], F.lit(default))


def compound_code(compound: Column) -> Column:
    codes = {name: float(code) for name, code in K.COMPOUND_CODES.items()}
    return lookup(F.upper(compound), codes, float(K.DEFAULT_COMPOUND_CODE))


def compound_penalty(compound: Column) -> Column:
    return lookup(compound, K.COMPOUND_PENALTIES, 0.0)


def base_lap_seconds(session_key: Column) -> Column:
    return lookup(session_key.cast("string"), {str(k): v for k, v in K.BASE_LAP_SECONDS.items()}, K.DEFAULT_BASE_LAP_SECONDS)


def path_token(text: Column) -> Column:
    """Text as a folder name: blanks become underscores."""
    return F.translate(text, " ", "_")


def percent_text(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)
