from pyspark.sql import functions as F
from conftest import day, dicts

from trackside.plans import served
from trackside.specs import CATALOG

KEY = 10014


def test_sessions(views):
    (row,) = dicts(served.sessions(views))
    assert row["session_key"] == KEY and row["country_name"] == "Harbour"


def test_drivers(views):
    rows = dicts(served.drivers(views, KEY))
    assert [r["driver_number"] for r in rows] == [44, 1] and rows[0]["name_acronym"] == "COS"
    assert dicts(served.drivers(views, 1)) == []


def test_telemetry(views):
    rows = dicts(served.telemetry(views, KEY, 44))
    assert len(rows) == 2 and rows[0]["speed"] == 307 and rows[0]["rpm"] == 10950
    assert rows[0]["date"] == "2025-03-16T12:00:00.000000"


def test_intervals(views):
    (row,) = dicts(served.intervals(views, KEY))
    assert row["driver"] == "COS" and row["gap_to_leader"] == "+3.207s"
    assert list(row) == ["driver", "team", "gap_to_leader", "interval", "date"]


def test_pit_stops(views):
    rows = dicts(served.pit_stops(views, KEY))
    assert [(r["driver"], r["stop_duration"]) for r in rows] == [("OKO", 2.1), ("COS", 2.3)]


def test_run_history(views):
    (row,) = dicts(served.run_history(views))
    assert row["run_id"] == "run-77" and row["status"] == "Success"


def test_weather(views):
    (row,) = dicts(served.weather(views, KEY))
    assert row["air_temperature"] == 21.5 and row["humidity"] == 45.0


def test_stints(views):
    rows = dicts(served.stints(views, KEY))
    assert [(r["driver"], r["compound"]) for r in rows] == [("COS", "SOFT"), ("OKO", "MEDIUM")]


def test_race_control_keeps_events_without_driver(views, spark):
    extra = spark.createDataFrame(
        [(KEY, None, "Flag", "RED", "Red flag", day("12:06:00"))], CATALOG["fact_race_control"].schema
    )
    rows = dicts(served.race_control({**views, "fact_race_control": views["fact_race_control"].union(extra)}, KEY))
    assert [(r["driver"], r["flag"], r["message"]) for r in rows] == [
        ("COS", "GREEN", "Green flag"),
        (None, "RED", "Red flag"),
    ]


def test_winner(views):
    (row,) = dicts(served.winner(views, KEY))
    assert row["driver"] == "OKO" and row["position"] == 1


def test_duel_location(views):
    rows = dicts(served.duel_location(views, KEY, 44))
    assert len(rows) == 2
    assert rows[0] == {"x": 1000, "y": 2000, "speed": 307, "gear": 7, "throttle": 97.5, "brake": 0.0}
    assert dicts(served.duel_location(views, 1, 44)) == []


def test_duel_location_counts_positions_before_alignment(spark, views):
    """The step comes from all positions, although early ones have no telemetry yet."""
    key = (KEY, 7)
    telemetry = [(*key, day("12:00:05"), None, None, None, 200, 1, 1, 1.0, 1.0, 1)]
    other = [(KEY, 8, day("12:00:00"), None, None, None, 200, 1, 1, 1.0, 1.0, 1)]
    places = [(*key, day(f"12:00:{s:02d}"), s, s, s) for s in range(10)]
    v = {
        "fact_car_telemetry": spark.createDataFrame(telemetry + other, CATALOG["fact_car_telemetry"].schema),
        "fact_car_location": spark.createDataFrame(places, CATALOG["fact_car_location"].schema),
    }
    rows = dicts(served.duel_location(v, KEY, 7, points=5))
    assert [r["x"] for r in rows] == [6, 8]


def test_duel_metrics(views):
    rows = {r["driver_number"]: r for r in dicts(served.duel_metrics(views, KEY, [44, 1]))}
    assert (rows[44]["max_speed"], rows[1]["max_speed"]) == (311, 318)
    assert (rows[44]["best_pit"], rows[1]["best_pit"]) == (19.4, 18.0)
    assert rows[44]["full_throttle_pct"] == 100.0 and rows[44]["heavy_brake_pct"] == 0.0


def test_overtakes(views, spark):
    (row,) = dicts(served.overtakes(views, KEY))
    assert (row["overtaking_driver"], row["overtaken_driver"], row["position"]) == ("OKO", "COS", 1)
    unknown = spark.createDataFrame([(KEY, 1, 99, day("12:11:00"), 2)], CATALOG["fact_overtakes"].schema)
    (row,) = dicts(served.overtakes({**views, "fact_overtakes": unknown}, KEY))
    assert (row["overtaking_driver"], row["overtaken_driver"]) == ("OKO", "99")


def test_lap_predictions_order_and_rounding(views, spark):
    rows = [
        (KEY, 1, 2, 20, "HARD", 3.0, 4, 1.0, 1.0, 1.0, 1.0, 90.12345, 90.0, 0.12345),
        (KEY, 1, 1, 3, "SOFT", 1.0, 2, 1.0, 1.0, 1.0, 1.0, 88.0, None, None),
    ]
    v = {"gold_lap_predictions": spark.createDataFrame(rows, CATALOG["gold_lap_predictions"].schema)}
    got = dicts(served.lap_predictions(v, KEY, 1))
    assert [(r["stint_number"], r["actual_lap_time"], r["delta"]) for r in got] == [(1, 88.0, None), (2, 90.123, 0.123)]
    assert dicts(served.lap_predictions(views, KEY, 1)) == []


def test_all_sessions_at_once_puts_keys_first(views):
    assert served.stints(views).columns[0] == "session_key"
    assert served.telemetry(views).columns[:2] == ["session_key", "driver_number"]


def test_dashboard(views, spark):
    text_dates = views["dim_weather"].withColumn("date", F.lit("2025-03-16T12:00:00.123456"))
    (row,) = dicts(served.dashboard_weather(text_dates))
    assert row["timestamp"] == day("12:00:00.123456")
    keys_as_text = views["fact_intervals"].withColumn("driver_number", F.col("driver_number").cast("string"))
    none_gap = keys_as_text.withColumn("gap_to_leader", F.lit("None"))
    (row,) = dicts(served.dashboard_gaps(keys_as_text.union(none_gap), views["dim_drivers"]))
    assert row["full_name"] == "Ana Costa" and row["interval"] == "+0.310s"
    assert [r["driver_number"] for r in dicts(served.dashboard_grid(views["dim_drivers"]))] == [44, 1]
    assert len(dicts(served.dashboard_telemetry(views["fact_car_telemetry"], rows=2))) == 2
