import math

import pytest
from conftest import day, dicts
from pyspark.sql import functions as F

from trackside import specs as S
from trackside.functions.scalars import int_or_zero, iso_micros, parse_iso
from trackside.functions.settings import parse_focus_drivers
from trackside.operators.validate import route_valid, split_valid, validate

DRIVERS = "driver_number long, full_name string, name_acronym string, team_name string, country_code string"
CAR = (
    "session_key long, driver_number long, date string, speed long, rpm long, n_gear long, "
    "throttle double, brake double, drs long"
)


def test_valid_driver(spark):
    df = spark.createDataFrame([(44, "Ana Costa", "COS", "Amber Racing", "GBR")], DRIVERS)
    checked = split_valid(df, S.DRIVERS, "r")
    assert checked.valid.count() == 1 and checked.quarantine.count() == 0


def test_missing_required_column_names_the_field(spark):
    df = spark.createDataFrame([("Ana Costa", "COS", "Amber Racing")], "full_name string, name_acronym string, team_name string")
    checked = split_valid(df, S.DRIVERS, "r")
    assert checked.valid.count() == 0
    (bad,) = dicts(checked.quarantine)
    assert "driver_number" in bad["error_detail"] and bad["quarantine_reason"] == "r"
    assert bad["quarantine_timestamp"] is not None and bad["full_name"] == "Ana Costa"


def test_telemetry_types(spark):
    good = (9400, 1, "2025-03-16T12:00:00", 307, 10950, 7, 97.5, 0.0, 12)
    df = spark.createDataFrame([good, (None, *good[1:])], CAR)
    checked = split_valid(df, S.CAR_DATA, "r")
    (row,) = dicts(checked.valid)
    assert row["date"] == day("12:00:00") and row["speed"] == 307
    (bad,) = dicts(checked.quarantine)
    assert "null in required column" in bad["error_detail"] and "session_key" in bad["error_detail"]


def test_missing_required_column_stops_a_typed_table(spark):
    with pytest.raises(ValueError, match="session_key"):
        validate(spark.createDataFrame([(1,)], "driver_number long"), S.CAR_DATA)


def test_every_problem_is_listed_and_each_row_routed_once(spark):
    row = (1, 1, "nonsense", None, 1, 1, math.nan, 1.0, 1)
    df = spark.createDataFrame([row], CAR)
    assert split_valid(df, S.CAR_DATA, "r").valid.count() == 0
    (bad,) = dicts(split_valid(df, S.CAR_DATA, "r").quarantine)
    assert "date:" in bad["error_detail"] and "speed:" in bad["error_detail"] and "throttle" not in bad["error_detail"]
    (errors,) = [r._errors for r in validate(df, S.CAR_DATA).collect()]
    assert len(errors) == 2


def cast_cases(spark, spec, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [(r._typed.x, list(r._errors)) for r in validate(df, spec).collect()]


def test_lax_and_strict_casts(spark):
    types = S.TableSpec("t", (S.Field("x", S.LONG, False, nullable=True),), mode="types")
    strict = S.TableSpec("t", (S.Field("x", S.LONG, False),))
    assert [v for v, _ in cast_cases(spark, types, "string", ["1.7", " 44 ", "", None])] == [None, 44, None, None]
    assert [len(e) for _, e in cast_cases(spark, types, "string", ["1.7", " 44 ", "", None])] == [1, 0, 1, 0]
    assert [v for v, _ in cast_cases(spark, types, "double", [1.7, math.nan])] == [1, None]
    assert [(v, len(e)) for v, e in cast_cases(spark, strict, "double", [44.0, 44.5, None])] == [(44, 0), (None, 1), (None, 0)]


def test_text_does_not_accept_numbers_in_contracts(spark):
    spec = S.TableSpec("t", (S.Field("x", S.TEXT),))
    assert [len(e) for _, e in cast_cases(spark, spec, "long", [5])] == [1]
    typed = S.TableSpec("t", (S.Field("x", S.TEXT, False),), mode="types")
    assert cast_cases(spark, typed, "long", [5, None]) == [("5", []), (None, [])]


def test_flags_and_times(spark):
    flag = S.TableSpec("t", (S.Field("x", S.FLAG, False),))
    assert [v for v, _ in cast_cases(spark, flag, "string", ["Yes", "0", "maybe", None])] == [True, False, None, None]
    assert [len(e) for _, e in cast_cases(spark, flag, "string", ["Yes", "0", "maybe", None])] == [0, 0, 1, 0]
    assert [v for v, _ in cast_cases(spark, flag, "double", [1.0, 0.5])] == [True, None]
    time = S.TableSpec("t", (S.Field("x", S.TIME),))
    values = ["2025-03-16T12:00:00+03:00", "2025-03-16T12:00:00Z", "2025-03-16T12:00:00.123456", "garbage"]
    got = cast_cases(spark, time, "string", values)
    assert [v for v, _ in got] == [day("09:00:00"), day("12:00:00"), day("12:00:00.123456"), None]
    assert [len(e) for _, e in got] == [0, 0, 0, 1]


def test_year_rule(spark):
    names = "session_key long, year long, session_name string, session_type string, circuit_key long, circuit_short_name string, country_name string"
    rows = [(1, y, "Race", "Race", 1, "A", "B") for y in (1999, 2000, 2100, 2101)]
    assert [r.year for r in split_valid(spark.createDataFrame(rows, names), S.SESSIONS, "r").valid.collect()] == [2000, 2100]


def test_relaxed_spec_keeps_open_stints(spark):
    names = ", ".join(f"{f.name} {f.type.simpleString()}" for f in S.STINTS.fields)
    df = spark.createDataFrame([(1, 1, 1, "SOFT", 1, None, 0)], names)
    assert split_valid(df, S.STINTS, "r").valid.count() == 0
    assert split_valid(df, S.relaxed(S.STINTS), "r").valid.count() == 1


def test_counters_and_extra_columns(spark):
    df = spark.createDataFrame([(44, "L", "COS", "F", "GBR"), (None, "x", "y", "z", None)], DRIVERS).withColumn(
        "extra", F.lit(1)
    )
    checked = split_valid(df, S.DRIVERS, "r")
    rows = dicts(checked.valid)
    assert rows[0]["extra"] == 1
    assert checked.counters() == {"read": 2, "valid": 1, "quarantined": 1}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(44, "L", "COS", "F", "GBR")], DRIVERS)
    plan = split_valid(df, S.DRIVERS, "r").valid._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_number_coercion(spark):
    df = spark.createDataFrame([("12",), ("1.9",), ("x",), (None,), ("nan",), ("1e400",)], "x string")
    assert [r.v for r in df.select(int_or_zero(F.col("x")).alias("v")).collect()] == [12, 1, 0, 0, 0, 0]


def test_iso_text(spark):
    df = spark.createDataFrame([("2025-03-16T12:00:00.5+01:00",)], "x string")
    assert df.select(iso_micros(parse_iso(F.col("x"))).alias("v")).head().v == "2025-03-16T11:00:00.500000"


def test_focus_drivers():
    assert parse_focus_drivers("1: Ben Okoro ,44") == {1: "Ben Okoro", 44: "Driver 44"}
    assert 81 in parse_focus_drivers("one:Max") and 81 in parse_focus_drivers(None)


def test_routed_in_one_pass(spark, tmp_path):
    raw = str(tmp_path / "raw")
    rows = [(9400, 1, "2025-03-16T12:00:00", "312", "a"), (9400, None, "2025-03-16T12:00:01", "x", "b"), (None, 2, None, "1", None)]
    spark.createDataFrame(rows, "session_key long, driver_number long, date string, speed string, extra string").write.parquet(raw)
    batch = spark.read.parquet(raw)
    split = split_valid(batch, S.CAR_DATA, "r")
    valid, bad = dicts(split.valid), dicts(split.quarantine.drop("quarantine_timestamp"))
    routed = route_valid(batch, S.CAR_DATA, "r")
    for side in (routed.valid, routed.quarantine):  # nothing reads the batch again
        assert side.inputFiles() and not any(raw in f for f in side.inputFiles())
    assert routed.counts == {"read": 3, "valid": len(valid), "quarantined": len(bad)}
    assert dicts(routed.valid) == valid and routed.valid.dtypes == split.valid.dtypes
    order = lambda r: str(r["extra"])
    assert sorted(dicts(routed.quarantine.drop("quarantine_timestamp")), key=order) == sorted(bad, key=order)
