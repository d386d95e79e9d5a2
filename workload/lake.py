"""A whole season from raw batches to silver, with what became of every row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.functions.scalars import iso_micros
from trackside.functions.settings import parse_focus_drivers
from trackside.plans.medallion import run_medallion
from trackside.session import scratch_path
from trackside.sources.bronze import land_bronze
from trackside.sources.lakehouse import register_lakehouse
from workload.registry import query
from workload.serving import RacingViews, over_views

YEAR = 2024
FOCUS = "1:First,2,3,5,8,13,21,34,55,89,144"
_FOCUS_SQL = ", ".join(str(n) for n in parse_focus_drivers(FOCUS))


def _land(v: RacingViews, root: str) -> None:
    """Every record kind of every week in one job each; dates as text, some overtakes without a position."""
    event = F.concat(F.lit("Week "), (F.col("session_key") - 9000).cast("string"))
    raw = {
        "sessions": v["dim_sessions"],
        "drivers": v._events().select("session_key", "driver_number").distinct().join(v["dim_drivers"], "driver_number"),
        "stints": v["dim_stints"],
        "weather": v["dim_weather"],
        "pit_stops": v["fact_pit_stops"],
        "intervals": v["fact_intervals"],
        "overtakes": v["fact_overtakes"].withColumn("position", F.when(F.col("position") != 7, F.col("position"))),
        "car_data": v["fact_car_telemetry"],
        "location": v["fact_car_location"].withColumns({c: F.col(c).cast("string") for c in ("x", "y", "z")}),
    }
    for kind, rows in raw.items():
        if "date" in rows.columns:
            rows = rows.withColumn("date", iso_micros(F.col("date")))
        rows = rows.withColumn("_event", event)
        land_bronze(rows.drop("session_key") if kind == "drivers" else rows, root, kind, YEAR, F.col("_event"), "Race")


_COUNTS = {
    "dim_sessions": "SELECT count(*) FROM dim_sessions",
    "dim_drivers": "SELECT count(DISTINCT d.driver_number) FROM dim_drivers d JOIN e ON e.driver_number = d.driver_number",
    "dim_stints": "SELECT count(*) FROM dim_stints WHERE lap_end IS NOT NULL",
    "dim_weather": "SELECT count(*) FROM dim_weather",
    "fact_pit_stops": "SELECT count(*) FROM fact_pit_stops",
    "fact_intervals": "SELECT count(*) FROM fact_intervals",
    "fact_overtakes": "SELECT count(*) FROM fact_overtakes WHERE position <> 7",
    "fact_car_location": f"SELECT count(*) FROM fact_car_location WHERE driver_number IN ({_FOCUS_SQL})",
    "fact_car_telemetry": f"""SELECT count(*) FROM (SELECT * FROM fact_car_location WHERE driver_number IN ({_FOCUS_SQL})) l
        ASOF JOIN fact_car_telemetry t ON l.session_key = t.session_key AND l.driver_number = t.driver_number AND l.date >= t.date""",
    "fact_race_control": "SELECT 0",
    "fact_session_results": "SELECT 0",
    "gold_lap_predictions": "SELECT 0",
    "fact_pipeline_execution": "SELECT count(*) FROM dim_sessions",
    "quarantine of overtakes": "SELECT count(*) FROM fact_overtakes WHERE position = 7",
    "quarantine of stints": "SELECT count(*) FROM dim_stints WHERE lap_end IS NULL",
}


@query(over_views(" UNION ALL ".join(f"SELECT '{name}' AS name, ({sql})::BIGINT AS n" for name, sql in _COUNTS.items())))
def medallion_season(spark, sf_dir):
    """Rows of every catalog view and of the quarantine after one run over all events of a season."""
    root = scratch_path(spark, "season")
    _land(RacingViews(spark, sf_dir), root)
    # A season that has no data falls back to the one before.
    run_medallion(spark, root, YEAR + 1, None, "Race", focus=parse_focus_drivers(FOCUS), lenient=False, with_gold=False)
    names = register_lakehouse(spark, root)

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    found = [counted(name, spark.table(name)) for name in names]
    for kind in ("overtakes", "stints"):
        found.append(counted(f"quarantine of {kind}", spark.read.parquet(f"{root}/quarantine/{kind}_corrupt")))
    return reduce(DataFrame.unionByName, found)
