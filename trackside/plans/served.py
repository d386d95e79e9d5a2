"""Served reads over the lakehouse views.

Each function takes the views as a dict of DataFrames. With ``session_key`` (and a driver)
it answers for that slice; without, for all slices in one plan, with the keys in front.
Ascending orders put NULL last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackside import constants as K
from trackside.functions.scalars import iso_micros, parse_with_format, pct_true
from trackside.operators.asof import asof_join
from trackside.operators.sampling import downsample
from trackside.session import materialise

Views = dict[str, DataFrame]
BUCKET_MICROS = 600 * 1_000_000  # rows of a session and driver are numbered in pieces of ten minutes


def _slice(df: DataFrame, session_key: int | None = None, driver_number: int | None = None) -> DataFrame:
    if session_key is not None:
        df = df.where(F.col("session_key") == session_key)
    if driver_number is not None:
        df = df.where(F.col("driver_number") == driver_number)
    return df


def _lead(session_key: int | None, *more: tuple[str, object]) -> list[str]:
    """Key columns that are not fixed by a parameter."""
    return [name for name, given in (("session_key", session_key), *more) if given is None]


def _asc(*columns: str | Column) -> list[Column]:
    return [F.asc_nulls_last(c) if isinstance(c, str) else c for c in columns]


def _with_driver(facts: DataFrame, drivers: DataFrame, how: str = "inner") -> DataFrame:
    names = drivers.select(
        "driver_number", F.col("name_acronym").alias("driver"), F.col("team_name").alias("team"), "full_name"
    )
    return facts.join(names, "driver_number", how)


def sessions(v: Views) -> DataFrame:
    return (
        v["dim_sessions"]
        .select("session_key", "year", "session_name", "session_type", "circuit_short_name", "country_name")
        .orderBy(F.desc("year"), *_asc("country_name", "session_key"))
    )


def drivers(v: Views, session_key: int | None = None) -> DataFrame:
    """Drivers with at least one stint in the session."""
    lead = _lead(session_key)
    active = _slice(v["dim_stints"], session_key).select(*lead, "driver_number").distinct()
    columns = ["driver_number", "full_name", "team_name", "name_acronym", "country_code"]
    return (
        active.join(v["dim_drivers"], "driver_number")
        .select(*lead, *columns)
        .distinct()
        .orderBy(*_asc(*lead, "team_name", "driver_number"))
    )


def intervals(v: Views, session_key: int | None = None) -> DataFrame:
    lead = _lead(session_key)
    rows = _with_driver(_slice(v["fact_intervals"], session_key), v["dim_drivers"])
    return rows.orderBy(*_asc(*lead, "date", "driver_number")).select(
        *lead, "driver", "team", "gap_to_leader", "interval", iso_micros(F.col("date")).alias("date")
    )


def pit_stops(v: Views, session_key: int | None = None) -> DataFrame:
    lead = _lead(session_key)
    rows = _with_driver(_slice(v["fact_pit_stops"], session_key), v["dim_drivers"])
    return rows.orderBy(*_asc(*lead, "lap_number", F.desc_nulls_last("pit_duration"), "date")).select(
        *lead,
        "driver",
        "team",
        "lap_number",
        "stop_duration",
        "lane_duration",
        "pit_duration",
        iso_micros(F.col("date")).alias("date"),
    )


def weather(v: Views, session_key: int | None = None) -> DataFrame:
    lead = _lead(session_key)
    return (
        _slice(v["dim_weather"], session_key)
        .orderBy(*_asc(*lead, "date"))
        .select(
            *lead,
            iso_micros(F.col("date")).alias("date"),
            "air_temperature",
            "track_temperature",
            "humidity",
            "wind_speed",
            "rainfall",
        )
    )


def stints(v: Views, session_key: int | None = None) -> DataFrame:
    lead = _lead(session_key)
    rows = _with_driver(_slice(v["dim_stints"], session_key), v["dim_drivers"])
    columns = ["driver", "team", "stint_number", "compound", "lap_start", "lap_end", "tyre_age_at_start"]
    return rows.select(*lead, *columns).orderBy(*_asc(*lead, "driver", "stint_number"))


def race_control(v: Views, session_key: int | None = None) -> DataFrame:
    """Messages in time order; those without a driver stay."""
    lead = _lead(session_key)
    rows = _with_driver(_slice(v["fact_race_control"], session_key), v["dim_drivers"], "left")
    return rows.orderBy(*_asc(*lead, "date", "message")).select(
        *lead, "driver", "category", "flag", "message", iso_micros(F.col("date")).alias("date")
    )


def winner(v: Views, session_key: int | None = None) -> DataFrame:
    lead = _lead(session_key)
    first = _slice(v["fact_session_results"], session_key).where(F.col("position") == 1)
    return _with_driver(first, v["dim_drivers"]).select(
        *lead, "driver", "full_name", "team", "position", "points", "number_of_laps"
    )


def duel_location(
    v: Views,
    session_key: int | None = None,
    driver_number: int | None = None,
    *,
    points: int = K.TRAJECTORY_POINTS,
) -> DataFrame:
    """Trajectory with the telemetry in force at each position, from the moment any car moves.

    The step comes from the number of positions, rows are counted after alignment, and rows
    without coordinates go last.
    """
    lead = _lead(session_key, ("driver_number", driver_number))
    key = ["session_key", "driver_number"]
    telemetry_rows = _slice(v["fact_car_telemetry"], session_key, driver_number)
    location_rows = _slice(v["fact_car_location"], session_key, driver_number)
    moving = (
        _slice(v["fact_car_telemetry"], session_key)
        .where(F.col("speed") > K.MOVING_SPEED)
        .groupBy("session_key")
        .agg(F.min("date").alias("_start"))
    )
    positions = (
        location_rows.select(*key, "date", "x", "y")
        .join(moving, "session_key")
        .where(F.col("date") >= F.col("_start"))
        .drop("_start")
    )
    measured = ["speed", "n_gear", "throttle", "brake"]
    aligned = asof_join(
        positions,
        telemetry_rows.select(*key, "date", *measured, F.lit(True).alias("_aligned")),
        by=key,
        on="date",
        right_cols=[*measured, "_aligned"],
        tie_break=measured,
        how="left_keyed",
    )
    # Read for the counts, the pieces and the rows: written once.
    aligned = materialise(aligned, "aligned")
    counts = aligned.groupBy(*key).agg(F.count(F.lit(1)).alias("_positions"))
    sampled = downsample(
        aligned.where("_aligned").join(counts, key),
        by=key,
        order=["date", "x", "y"],
        target=points,
        rounding="floor",
        size="_positions",
        widths=[BUCKET_MICROS],
    )
    return (
        sampled.where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .orderBy(*key, "rn")
        .select(*lead, "x", "y", "speed", F.col("n_gear").alias("gear"), "throttle", "brake")
    )


def duel_metrics(v: Views, session_key: int | None = None, drivers_: list[int] | None = None) -> DataFrame:
    """Peak values, time shares and best pit stop per driver; NULL where a driver never pitted."""
    key = ["session_key", "driver_number"]

    def chosen(df: DataFrame) -> DataFrame:
        rows = _slice(df, session_key)
        return rows if drivers_ is None else rows.where(F.col("driver_number").isin(drivers_))

    pits = chosen(v["fact_pit_stops"]).groupBy(*key).agg(F.min("pit_duration").alias("best_pit"))
    measured = (
        chosen(v["fact_car_telemetry"])
        .groupBy(*key)
        .agg(
            F.coalesce(F.max("speed"), F.lit(0)).alias("max_speed"),
            F.coalesce(F.max("rpm"), F.lit(0)).alias("max_rpm"),
            F.round(pct_true(F.col("throttle") > K.FULL_THROTTLE), 1).alias("full_throttle_pct"),
            F.round(pct_true(F.col("brake") > K.HEAVY_BRAKE), 1).alias("heavy_brake_pct"),
            F.round(pct_true(F.col("drs") > 0), 1).alias("drs_pct"),
        )
    )
    return measured.join(pits, key, "left").select(
        *_lead(session_key),
        "driver_number",
        "max_speed",
        "max_rpm",
        "full_throttle_pct",
        "heavy_brake_pct",
        "drs_pct",
        "best_pit",
    )


def lap_predictions(v: Views, session_key: int | None = None, driver_number: int | None = None) -> DataFrame:
    lead = _lead(session_key, ("driver_number", driver_number))
    rows = _slice(v["gold_lap_predictions"], session_key, driver_number)
    return rows.orderBy(*_asc(*lead, "stint_number", "lap_number")).select(
        *lead,
        "stint_number",
        "compound",
        F.col("tyre_age_at_start").alias("tyre_age"),
        F.round("lap_duration_seconds", 3).alias("actual_lap_time"),
        F.round("predicted_lap_duration_seconds", 3).alias("predicted_lap_time"),
        F.round("delta_performance_seconds", 3).alias("delta"),
    )


def overtakes(v: Views, session_key: int | None = None) -> DataFrame:
    """Acronyms of both drivers, the number where a driver is not in the dimension."""
    lead = _lead(session_key)
    names = v["dim_drivers"].select("driver_number", F.nullif("name_acronym", F.lit("")).alias("_name"))

    def name(role: str) -> DataFrame:
        return names.withColumnsRenamed({"driver_number": f"{role}_driver_number", "_name": f"{role}_driver"})

    rows = _slice(v["fact_overtakes"], session_key)
    for role in ("overtaking", "overtaken"):
        number = f"{role}_driver_number"
        rows = rows.join(name(role), number, "left").withColumn(
            f"{role}_driver", F.coalesce(f"{role}_driver", F.col(number).cast("string"), F.lit(""))
        )
    return rows.orderBy(*_asc(*lead, "date", "overtaking_driver_number", "overtaken_driver_number")).select(
        *lead, "overtaking_driver", "overtaken_driver", "position", iso_micros(F.col("date")).alias("date")
    )


def run_history(v: Views) -> DataFrame:
    return (
        v["fact_pipeline_execution"]
        .orderBy(F.desc_nulls_last("execution_timestamp"), "run_id")
        .select(
            "run_id",
            "pipeline_name",
            "session_key",
            "execution_timestamp",
            F.round("duration_seconds", 2).alias("duration_seconds"),
            "status",
            "total_rows_processed",
        )
    )


def telemetry(
    v: Views,
    session_key: int | None = None,
    driver_number: int | None = None,
    *,
    points: int = K.TELEMETRY_POINTS,
) -> DataFrame:
    """Telemetry thinned to about ``points`` rows per session and driver, never more."""
    lead = _lead(session_key, ("driver_number", driver_number))
    key = ["session_key", "driver_number"]
    measured = ["speed", "rpm", "n_gear", "throttle", "brake", "drs"]
    rows = _slice(v["fact_car_telemetry"], session_key, driver_number).select(*key, "date", *measured)
    kept = downsample(rows, by=key, order=["date", *measured], target=points, rounding="half_even", cap=points, widths=[BUCKET_MICROS])
    return kept.orderBy(*key, "rn").select(*lead, iso_micros(F.col("date")).alias("date"), *measured)


def dashboard_weather(weather_rows: DataFrame) -> DataFrame:
    """Weather with its text date parsed."""
    return weather_rows.orderBy(*_asc("date")).select(
        parse_with_format(F.col("date"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "air_temperature",
        "track_temperature",
        "humidity",
    )


def dashboard_gaps(intervals_rows: DataFrame, drivers_rows: DataFrame, rows: int | None = K.GAP_ROWS) -> DataFrame:
    """Distinct gaps with driver names; keys are compared as numbers whatever their type."""
    number = F.col("driver_number").cast("string").try_cast("bigint").alias("_number")
    gaps = intervals_rows.where(F.col("gap_to_leader").isNotNull() & (F.col("gap_to_leader") != "None")).select(
        number, "gap_to_leader", "interval"
    )
    names = drivers_rows.select(number, "full_name", "team_name", "name_acronym")
    columns = ["full_name", "team_name", "name_acronym", "gap_to_leader", "interval"]
    distinct = gaps.join(names, "_number").select(*columns).distinct().orderBy(*_asc(*columns))
    return distinct if rows is None else distinct.limit(rows)


def dashboard_grid(drivers_rows: DataFrame) -> DataFrame:
    return (
        drivers_rows.select("driver_number", "full_name", "team_name", "country_code")
        .distinct()
        .orderBy(*_asc("team_name", "driver_number"))
    )


def dashboard_telemetry(telemetry_rows: DataFrame, rows: int = K.TELEMETRY_HEAD_ROWS) -> DataFrame:
    columns = ["date", "speed", "rpm", "n_gear"]
    return telemetry_rows.select(*columns).orderBy(*_asc(*columns)).limit(rows)
