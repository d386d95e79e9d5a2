"""Which sessions of a season to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.constants import SEASON_FALLBACK
from trackside.functions.scalars import contains_text
from trackside.operators.tables import latest, match_or_all


def season(sessions: DataFrame, year: int | None) -> DataFrame:
    """Sessions of the year, or of its fallback year when it has none; all years for None.

    Adds ``year_actual``.
    """
    if year is not None:
        years = [year, *([SEASON_FALLBACK[year]] if year in SEASON_FALLBACK else [])]
        available = sessions.where(F.col("year").isin(years))
        preferred = available.agg(
            F.coalesce(F.max(F.when(F.col("year") == year, F.col("year"))), F.max("year")).alias("year")
        )
        sessions = available.where(F.col("year") == preferred.scalar())
    return sessions.withColumn("year_actual", F.col("year"))


def resolve_session(sessions: DataFrame, year: int | None, event: str | None, session_name: str) -> DataFrame:
    """The latest matching session per season.

    ``event`` is looked for in country and circuit names; when nothing matches, all sessions
    stay. The same holds for ``session_name``.
    """
    rows = season(sessions, year)
    if event:
        named = contains_text(F.col("country_name"), event) | contains_text(F.col("circuit_short_name"), event)
        rows = match_or_all(rows, named, ["year"]).drop("matched")
    rows = match_or_all(rows, contains_text(F.col("session_name"), session_name), ["year"]).drop("matched")
    return latest(rows, ["year"], ["date_start", "session_key"])


def list_sessions(sessions: DataFrame, year: int | None, session_name: str) -> DataFrame:
    """All sessions of a type, oldest first; without any match all sessions, newest first."""
    rows = match_or_all(season(sessions, year), contains_text(F.col("session_name"), session_name), ["year"])
    age = F.unix_micros(F.col("date_start").cast("timestamp"))
    return rows.orderBy(
        "year", F.asc_nulls_last(F.when(F.col("matched"), age).otherwise(-age)), "session_key"
    ).drop("matched")
