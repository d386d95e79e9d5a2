from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from trackside.session import configure  # noqa: E402
from trackside.specs import CATALOG  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("trackside-tests")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def day(clock: str) -> datetime:
    return at(f"2025-03-16 {clock}")


# The query fixture: one session, two drivers.
ROWS = {
    "dim_sessions": [(10014, 2025, "Race", "Race", 12, "Harbour GP", "Harbour")],
    "dim_drivers": [
        (44, "Ana Costa", "COS", "Amber Racing", "GBR"),
        (1, "Ben Okoro", "OKO", "Cobalt Works", "NED"),
    ],
    "dim_stints": [(10014, 44, 1, "SOFT", 1, 15, 0), (10014, 1, 1, "MEDIUM", 1, 18, 0)],
    "fact_car_telemetry": [
        (10014, 44, day("12:00:00.000"), None, None, None, 307, 10950, 7, 97.5, 0.0, 12),
        (10014, 44, day("12:00:01.000"), None, None, None, 311, 12000, 7, 99.0, 0.0, 12),
        (10014, 1, day("12:00:00.000"), None, None, None, 318, 12340, 8, 100.0, 0.0, 12),
    ],
    "fact_car_location": [
        (10014, 44, day("12:00:00.005"), 1000, 2000, 100),
        (10014, 44, day("12:00:01.005"), 1010, 2010, 100),
        (10014, 1, day("12:00:00.005"), 990, 1990, 100),
    ],
    "fact_intervals": [(10014, 44, "+3.207s", "+0.310s", day("12:00:01"))],
    "fact_pit_stops": [
        (10014, 44, 15, 2.3, 17.1, 19.4, day("12:30:00")),
        (10014, 1, 14, 2.1, 15.9, 18.0, day("12:28:00")),
    ],
    "fact_pipeline_execution": [
        ("run-77", "Silver_Pipeline", 10014, "2026-06-10T13:00:00", 0.29, "Success", 6412)
    ],
    "fact_session_results": [(10014, 1, 1, 57, 25.0, None, None, None, None, None)],
    "dim_weather": [(10014, day("12:00:00"), 21.5, 31.2, 45.0, 12.0, 0)],
    "fact_race_control": [(10014, 44, "Flag", "GREEN", "Green flag", day("12:05:00"))],
    "fact_overtakes": [(10014, 1, 44, day("12:10:00"), 1)],
    "gold_lap_predictions": [],
}


@pytest.fixture(scope="session")
def views(spark):
    return {name: spark.createDataFrame(rows, CATALOG[name].schema) for name, rows in ROWS.items()}


def dicts(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]
