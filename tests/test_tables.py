from conftest import at, dicts
from pyspark.sql import functions as F

from trackside.operators.quality import any_value, mean_within, quality_report, telemetry_rules
from trackside.operators.numbering import numbered
from trackside.operators.tables import dedup_first, expand_range, latest, match_or_all, union_all, upsert
from trackside.plans.season import list_sessions, resolve_session


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([(44, "Mercedes"), (1, "Red Bull")], "driver_number long, team string")
    new = spark.createDataFrame([(44, "Amber Racing", "GBR")], "driver_number long, team string, code string")
    rows = {r["driver_number"]: r for r in dicts(upsert(old, new, ["driver_number"]))}
    assert rows[44]["team"] == "Amber Racing" and rows[1] == {"driver_number": 1, "team": "Red Bull", "code": None}


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, 2)], "x long, y long"), spark.createDataFrame([(3, 4)], "y long, z long")
    assert dicts(union_all([a, b])) == [{"x": 1, "y": 2, "z": None}, {"x": None, "y": 3, "z": 4}]


def test_first_and_latest(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 3, "c"), (1, 2, "b"), (2, None, "z"), (None, 1, "k")], "k long, o long, v string")
    assert {(r.k, r.v) for r in dedup_first(df, ["k"], ["o"]).collect()} == {(1, "b"), (2, "z"), (None, "k")}
    assert {(r.k, r.v) for r in latest(df, ["k"], ["o"]).collect()} == {(1, "c"), (2, "z"), (None, "k")}


def test_match_or_all(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, None), (None, "a"), (None, "d")], "g long, v string")
    got = {(r.g, r.v) for r in match_or_all(df, F.col("v") == "a", ["g"]).collect()}
    assert got == {(1, "a"), (2, "c"), (2, None), (None, "a")}


def test_expand_range(spark):
    df = spark.createDataFrame([(1, 5, 7), (2, 5, None), (3, 5, 3), (4, 5, 5), (5, None, 2)], "id long, a long, b long")
    rows = expand_range(df, "a", "b", index="i", value="lap").collect()
    laps = {k: [r.lap for r in rows if r.id == k] for k in range(1, 6)}
    assert laps[1] == [5, 6, 7] and laps[2] == list(range(5, 16)) and laps[3] == list(range(5, 11)) and laps[4] == [5]
    long = expand_range(spark.createDataFrame([(1, 3, 10_000)], "id long, a long, b long"), "a", "b", index="i", value="lap")
    assert [(r.i, r.lap) for r in long.orderBy("i").collect()] == [(i, i + 3) for i in range(9_998)]
    assert laps[5] == [None] and [r.i for r in rows if r.id == 1] == [0, 1, 2]


def test_quality_report(spark):
    df = spark.createDataFrame([(300, 7, 12000), (381, -2, 16001), (None, 8, 0)], "speed long, n_gear long, rpm long")
    report = quality_report(
        df, telemetry_rules(), table_rules={"mean": mean_within("speed", (300, 350)), "seen": any_value("rpm")}
    )
    assert {r.rule: (r.failing, r.total) for r in report.collect()} == {
        "speed_range": (2, 3),
        "gear_range": (1, 3),
        "rpm_range": (1, 3),
        "not_empty": (0, 3),
        "mean": (0, 3),
        "seen": (0, 3),
    }
    empty = quality_report(df.limit(0), telemetry_rules(), table_rules={"mean": mean_within("speed", (0, 1))})
    assert {r.rule: r.failing for r in empty.collect()}["not_empty"] == 1


SESSIONS = [
    (1, 2024, "Race", "Harbour", "Quay", "2024-03-02"),
    (2, 2024, "Qualifying", "Harbour", "Quay", "2024-03-01"),
    (3, 2024, "Race", "Monaco", "Monte Carlo", "2024-05-26"),
    (4, 2024, "Sprint", None, "Miami", "2024-05-04"),
]


def sessions(spark, rows=SESSIONS):
    names = "session_key long, year long, session_name string, country_name string, circuit_short_name string, date_start timestamp_ntz"
    return spark.createDataFrame([(*r[:5], at(r[5])) for r in rows], names)


def test_resolve_session(spark):
    def key(*args):
        return [(r.session_key, r.year_actual) for r in resolve_session(sessions(spark), *args).collect()]

    assert key(2024, "harbour", "race") == [(1, 2024)]
    assert key(2024, "CARLO", "Race") == [(3, 2024)]
    assert key(2024, "nowhere", "Race") == [(3, 2024)]  # event unknown: latest race of the season
    assert key(2024, "Harbour", "Sprint") == [(1, 2024)]  # name unknown at the event: its latest session
    assert key(2025, None, "Sprint") == [(4, 2024)]  # season without data
    assert key(2023, None, "Race") == []
    assert key(2024, "[", "Race") == [(3, 2024)]  # literal text, not a pattern


def test_list_sessions(spark):
    def keys(name):
        return [r.session_key for r in list_sessions(sessions(spark), 2024, name).collect()]

    assert keys("race") == [1, 3]
    assert keys("Practice") == [3, 4, 1, 2]


def test_numbered_along_its_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5).orderBy(F.desc("v"))
    found = numbered(df)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.position, r.v) for r in found.collect()) == [(k + 1, 999 - k) for k in range(1000)]
    assert numbered(df.where("v < 0")).collect() == [] and numbered(df, "n").columns == ["v", "n"]
