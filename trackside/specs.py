"""Table contracts: columns, types, which are required, value rules and partitioning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

from trackside.constants import YEAR_RANGE

LONG, DOUBLE, TEXT, FLAG, TIME = (
    T.LongType(),
    T.DoubleType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    required: bool = True
    between: tuple[float, float] | None = None
    nullable: bool = False


@dataclass(frozen=True)
class TableSpec:
    """One table.

    ``mode="contract"``: every field is checked on its own, text does not accept numbers,
    integers do not accept fractions; optional fields may be NULL or absent.
    ``mode="types"``: required fields must be present and not NULL, integers may never be
    NULL, numbers are cast to the column type; other absent fields are skipped.
    """

    name: str
    fields: tuple[Field, ...]
    mode: str = "contract"
    partition_by: tuple[str, ...] = ()
    bronze: str | None = None
    keys: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, True) for f in self.fields])


def relaxed(spec: TableSpec) -> TableSpec:
    """The same table with NULL allowed in optional integer columns."""
    return replace(spec, fields=tuple(f if f.required else replace(f, nullable=True) for f in spec.fields))


def _fields(*rows) -> tuple[Field, ...]:
    return tuple(Field(*row) for row in rows)


SESSIONS = TableSpec(
    "dim_sessions",
    (
        Field("session_key", LONG),
        Field("year", LONG, between=YEAR_RANGE),
        Field("session_name", TEXT),
        Field("session_type", TEXT),
        Field("circuit_key", LONG),
        Field("circuit_short_name", TEXT),
        Field("country_name", TEXT),
    ),
    partition_by=("session_key",),
    bronze="sessions",
)
DRIVERS = TableSpec(
    "dim_drivers",
    _fields(
        ("driver_number", LONG),
        ("full_name", TEXT),
        ("name_acronym", TEXT),
        ("team_name", TEXT),
        ("country_code", TEXT, False),
    ),
    bronze="drivers",
    keys=("driver_number",),
)
STINTS = TableSpec(
    "dim_stints",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("stint_number", LONG),
        ("compound", TEXT, False),
        ("lap_start", LONG, False),
        ("lap_end", LONG, False),
        ("tyre_age_at_start", LONG, False),
    ),
    mode="types",
    partition_by=("session_key",),
    bronze="stints",
)
WEATHER = TableSpec(
    "dim_weather",
    _fields(
        ("session_key", LONG),
        ("date", TIME),
        ("air_temperature", DOUBLE, False),
        ("track_temperature", DOUBLE, False),
        ("humidity", DOUBLE, False),
        ("wind_speed", DOUBLE, False),
        ("rainfall", LONG, False),
    ),
    mode="types",
    partition_by=("session_key",),
    bronze="weather",
)
RACE_CONTROL = TableSpec(
    "fact_race_control",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG, False),
        ("category", TEXT),
        ("flag", TEXT, False),
        ("message", TEXT),
        ("date", TIME),
    ),
    partition_by=("session_key",),
    bronze="race_control",
)
PIT_STOPS = TableSpec(
    "fact_pit_stops",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("lap_number", LONG),
        ("stop_duration", DOUBLE, False),
        ("lane_duration", DOUBLE, False),
        ("pit_duration", DOUBLE, False),
        ("date", TIME, False),
    ),
    mode="types",
    partition_by=("session_key",),
    bronze="pit_stops",
)
INTERVALS = TableSpec(
    "fact_intervals",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("gap_to_leader", TEXT, False),
        ("interval", TEXT, False),
        ("date", TIME),
    ),
    mode="types",
    partition_by=("session_key",),
    bronze="intervals",
)
SESSION_RESULTS = TableSpec(
    "fact_session_results",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("position", LONG, False),
        ("number_of_laps", LONG, False),
        ("points", DOUBLE, False),
        ("dnf", FLAG, False),
        ("dns", FLAG, False),
        ("dsq", FLAG, False),
        ("duration", DOUBLE, False),
        ("gap_to_leader", TEXT, False),
    ),
    partition_by=("session_key",),
    bronze="session_result",
)
OVERTAKES = TableSpec(
    "fact_overtakes",
    _fields(
        ("session_key", LONG),
        ("overtaking_driver_number", LONG),
        ("overtaken_driver_number", LONG),
        ("date", TIME),
        ("position", LONG),
    ),
    partition_by=("session_key",),
    bronze="overtakes",
)
LOCATION = TableSpec(
    "fact_car_location",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("date", TIME),
        ("x", LONG, False),
        ("y", LONG, False),
        ("z", LONG, False),
    ),
    mode="types",
    partition_by=("session_key", "driver_number"),
    bronze="location",
)
CAR_DATA = TableSpec(
    "car_data",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("date", TIME),
        ("speed", LONG, False),
        ("rpm", LONG, False),
        ("n_gear", LONG, False),
        ("throttle", DOUBLE, False),
        ("brake", DOUBLE, False),
        ("drs", LONG, False),
    ),
    mode="types",
    partition_by=("session_key", "driver_number"),
    bronze="car_data",
)
TELEMETRY = TableSpec(
    "fact_car_telemetry",
    LOCATION.fields + CAR_DATA.fields[3:],
    mode="types",
    partition_by=("session_key", "driver_number"),
)
RUNS = TableSpec(
    "fact_pipeline_execution",
    _fields(
        ("run_id", TEXT),
        ("pipeline_name", TEXT),
        ("session_key", LONG),
        ("execution_timestamp", TEXT),
        ("duration_seconds", DOUBLE),
        ("status", TEXT),
        ("total_rows_processed", LONG),
    ),
    partition_by=("session_key",),
)
LAP_FEATURES = TableSpec(
    "features_lap_data",
    _fields(
        ("session_key", LONG),
        ("driver_number", LONG),
        ("stint_number", LONG),
        ("lap_number", LONG),
        ("compound", TEXT),
        ("compound_num", DOUBLE),
        ("tyre_age_at_start", LONG),
        ("max_speed", DOUBLE),
        ("max_rpm", DOUBLE),
        ("throttle_intensity_pct", DOUBLE),
        ("brake_intensity_pct", DOUBLE),
        ("lap_duration_seconds", DOUBLE),
    ),
)
LAP_PREDICTIONS = TableSpec(
    "gold_lap_predictions",
    LAP_FEATURES.fields
    + _fields(("predicted_lap_duration_seconds", DOUBLE), ("delta_performance_seconds", DOUBLE)),
)

SILVER = {
    s.name: s
    for s in (
        SESSIONS,
        DRIVERS,
        STINTS,
        WEATHER,
        RACE_CONTROL,
        PIT_STOPS,
        INTERVALS,
        SESSION_RESULTS,
        OVERTAKES,
        LOCATION,
        TELEMETRY,
        RUNS,
    )
}
CATALOG = {**SILVER, LAP_PREDICTIONS.name: LAP_PREDICTIONS}
BRONZE = {
    s.bronze: s
    for s in (
        SESSIONS,
        DRIVERS,
        STINTS,
        WEATHER,
        RACE_CONTROL,
        PIT_STOPS,
        INTERVALS,
        SESSION_RESULTS,
        OVERTAKES,
        LOCATION,
        CAR_DATA,
    )
}
