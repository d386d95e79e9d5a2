import json
import os

import pytest
from conftest import ROWS, dicts
from pyspark.sql import functions as F

from trackside.operators.numbering import numbered
from trackside.plans.gateway import QueryRejected, ReadOnlySql
from trackside.plans.medallion import run_medallion
from trackside.session import scratch_path
from trackside.sources import bronze
from trackside.sources.archive import archive_json, read_archive
from trackside.sources.ci import flatten_steps, read_reports
from trackside.sources import lakehouse, snapshots
from trackside.sources.lakehouse import publish, published, read_table, register_lakehouse, replace_partitions, store
from trackside.sources.runs import log_runs, run_record
from trackside.plans.builds import pick_run, triage
from trackside import specs as S


def test_replace_partitions_leaves_the_others(spark):
    path = scratch_path(spark, "t")
    replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "session_key long, v string"), path, ["session_key"])
    again = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "session_key long, v string")
    for _ in range(2):
        replace_partitions(again, path, ["session_key"])
    assert sorted((r.session_key, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]


def test_publish_over_its_own_input(spark):
    path = scratch_path(spark, "t")
    publish(spark, spark.range(3), path)
    publish(spark, published(spark, path).where("id > 0"), path)
    assert sorted(r.id for r in published(spark, path).collect()) == [1, 2]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_second_writer_on_one_version_is_refused(spark):
    path = scratch_path(spark, "t")
    base = snapshots.commit(spark, spark.range(3), path, snapshots.current(spark, path))
    held = published(spark, path)
    assert snapshots.commit(spark, spark.range(3, 5), path, base) == base + 1
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, spark.range(9), path, base)
    assert ids(published(spark, path)) == [3, 4]
    assert ids(held) == ids(published(spark, path, base)) == [0, 1, 2]  # a reader keeps its version
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 2  # what was refused has left nothing
    assert snapshots.expire(spark, path) == 1 and ids(published(spark, path)) == [3, 4]
    with pytest.raises(ValueError):
        published(spark, path, base)


def test_second_writer_merges(spark):
    path = scratch_path(spark, "t")
    snapshots.commit(spark, spark.range(2), path, 0)
    asked = []

    def make(folder):
        asked.append(folder)
        if len(asked) == 1:  # another writer comes in between
            snapshots.commit(spark, spark.range(5, 7), path, snapshots.current(spark, path))
        return spark.read.parquet(folder).union(spark.range(10, 11))

    assert snapshots.update(spark, path, make) == 3 and len(set(asked)) == 2
    assert ids(published(spark, path)) == [5, 6, 10]
    with pytest.raises(snapshots.Conflict):
        snapshots.update(spark, path, lambda folder: (snapshots.commit(spark, spark.range(1), path, snapshots.current(spark, path)), spark.range(1))[1], 2)
    with pytest.raises(ValueError):
        published(spark, scratch_path(spark, "none"))


def test_two_runs_upsert_the_same_table(spark, monkeypatch):
    root, names = scratch_path(spark, "lake"), S.DRIVERS.schema
    store(spark, root, S.DRIVERS, spark.createDataFrame([(44, "L", "COS", "Mercedes", None)], names))
    other = spark.createDataFrame([(1, "M", "OKO", "RB", None)], names)
    real, calls = lakehouse.upsert, []

    def upsert_late(*args):
        calls.append(1)
        if len(calls) == 1:
            store(spark, root, S.DRIVERS, other)
        return real(*args)

    monkeypatch.setattr(lakehouse, "upsert", upsert_late)
    store(spark, root, S.DRIVERS, spark.createDataFrame([(44, "L", "COS", "Amber Racing", "GBR")], names))
    assert {r.driver_number: r.team_name for r in read_table(spark, root, S.DRIVERS).collect()} == {44: "Amber Racing", 1: "RB"}


def test_store_upserts_drivers_and_replaces_sessions(spark):
    root = scratch_path(spark, "lake")
    names = S.DRIVERS.schema
    store(spark, root, S.DRIVERS, spark.createDataFrame([(44, "L", "COS", "Mercedes", None), (1, "M", "OKO", "RB", None)], names))
    store(spark, root, S.DRIVERS, spark.createDataFrame([(44, "L", "COS", "Amber Racing", "GBR")], names))
    assert {r.driver_number: r.team_name for r in read_table(spark, root, S.DRIVERS).collect()} == {44: "Amber Racing", 1: "RB"}
    for laps in ([(1, 9, 1, "SOFT", 1, 2, 0), (2, 9, 1, "SOFT", 1, 2, 0)], [(2, 9, 1, "HARD", 1, 2, 0)]):
        store(spark, root, S.STINTS, spark.createDataFrame(laps, S.STINTS.schema))
    assert {r.session_key: r.compound for r in read_table(spark, root, S.STINTS).collect()} == {1: "SOFT", 2: "HARD"}


def test_catalog_has_typed_empty_tables(spark):
    names = register_lakehouse(spark, scratch_path(spark, "none"))
    assert len(names) == 13
    assert spark.table("gold_lap_predictions").schema == S.LAP_PREDICTIONS.schema
    assert all(spark.table(n).isEmpty() for n in names)


def test_run_history_appends(spark):
    root = scratch_path(spark, "runs")
    log_runs(spark, root, run_record("p", 7, 1.5, 12))
    log_runs(spark, root, run_record("p", None, 0.5, 3, ValueError("x" * 300)))
    rows = {r.session_key: r for r in read_table(spark, root, S.RUNS).collect()}
    assert rows[7].status == "SUCCESS" and rows[7].total_rows_processed == 12
    assert rows[0].status == "FAILED: " + "x" * 100 and rows[0].total_rows_processed == 0


def land(spark, root, kind, rows, names, gp="Harbour"):
    return bronze.land_bronze(spark.createDataFrame(rows, names), root, kind, 2025, gp, "Race")


SESSION = "session_key long, year long, session_name string, session_type string, circuit_key long, circuit_short_name string, country_name string, date_start string"
DRIVER = "driver_number long, full_name string, name_acronym string, team_name string, country_code string"
STINT = "session_key long, driver_number long, stint_number long, compound string, lap_start long, lap_end long, tyre_age_at_start long"
CAR = "session_key long, driver_number long, date string, speed long, rpm long, n_gear long, throttle double, brake double, drs long"


@pytest.fixture(scope="module")
def lake(spark):
    root = scratch_path(spark, "medallion")
    land(spark, root, "sessions", [(10014, 2025, "Race", "Race", 12, "Quay", "Harbour", "2025-03-16")], SESSION)
    land(spark, root, "drivers", [(44, "L", "COS", "Amber Racing", "GBR"), (1, "M", "OKO", "RB", None), (None, "x", "y", "z", None)], DRIVER)
    land(spark, root, "stints", [(10014, 1, 1, "MEDIUM", 1, 10, 0), (10014, 1, 2, "HARD", 11, None, 0)], STINT)
    second = "2025-03-16T12:00:0"
    land(
        spark,
        root,
        "car_data",
        [(10014, 1, f"{second}0+00:00", 307, 10950, 7, 97.5, 0.0, 12), (10014, 1, f"{second}1", 311, 12000, 77, 97.5, 0.0, 12), (10014, 5, f"{second}0", 1, 1, 1, 1.0, 1.0, 1)],
        CAR,
    )
    place = "session_key long, driver_number long, date string, x string, y string, z string"
    land(
        spark,
        root,
        "location",
        [(10014, 1, "2025-03-16T11:59:59", "9", "9", "9"), (10014, 1, f"{second}0.005", "1", "x", None), (10014, 1, f"{second}1.005", "1", "2", "3"), (10014, 5, f"{second}1", "1", "2", "3")],
        place,
    )
    land(spark, root, "sessions", [(9979, 2025, "Race", "Race", 13, "Monte Carlo", "Monaco", "2025-05-25")], SESSION, gp="Monaco GP")
    return root


def test_medallion(spark, lake):
    counts = run_medallion(spark, lake, 2025, "Harbour", "Race", forest={"trees": 3, "depth": 3})
    assert counts == {"read": 13, "valid": 11, "quarantined": 2}
    assert [r.session_key for r in read_table(spark, lake, S.SESSIONS).collect()] == [10014]
    assert "date_start" in read_table(spark, lake, S.SESSIONS).columns
    assert read_table(spark, lake, S.DRIVERS).count() == 2
    assert [r.stint_number for r in read_table(spark, lake, S.STINTS).collect()] == [1]
    rows = read_table(spark, lake, S.TELEMETRY).orderBy("date").collect()
    # The position before the first car data is dropped, odd gears become 0, other drivers are left out.
    assert [(r.driver_number, r.x, r.y, r.z, r.speed, r.n_gear) for r in rows] == [(1, 1, 0, 0, 307, 7), (1, 1, 2, 3, 311, 0)]
    assert read_table(spark, lake, S.LOCATION).count() == 3
    predictions = read_table(spark, lake, S.LAP_PREDICTIONS).collect()
    assert len(predictions) == 10
    assert all(abs(r.lap_duration_seconds - r.predicted_lap_duration_seconds - r.delta_performance_seconds) < 1e-9 for r in predictions)
    bad = dicts(spark.read.parquet(f"{lake}/quarantine/drivers_corrupt"))
    assert len(bad) == 1 and "driver_number" in bad[0]["error_detail"] and bad[0]["gp"] == "Harbour"
    (run,) = read_table(spark, lake, S.RUNS).collect()
    assert run.session_key == 10014 and run.status == "SUCCESS" and run.total_rows_processed == 9

    # A second run changes nothing but the history; all events of the season go in one job.
    run_medallion(spark, lake, 2025, None, "Race", with_gold=False)
    assert sorted(r.session_key for r in read_table(spark, lake, S.SESSIONS).collect()) == [9979, 10014]
    assert read_table(spark, lake, S.TELEMETRY).count() == 2 and read_table(spark, lake, S.DRIVERS).count() == 2
    runs = read_table(spark, lake, S.RUNS).where("pipeline_name like 'silver_all%'").collect()
    # Each session logs its own rows.
    assert {r.session_key: r.total_rows_processed for r in runs} == {10014: 9, 9979: 1}


def test_failure_is_logged_under_the_session(spark, lake, monkeypatch):
    monkeypatch.setattr("trackside.plans.medallion.align_telemetry", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_medallion(spark, lake, 2025, "Harbour", "Race", with_gold=False)
    (run,) = read_table(spark, lake, S.RUNS).where("status like 'FAILED%'").collect()
    assert run.session_key == 10014 and run.total_rows_processed == 0


def test_no_folder_no_fallback(spark, monkeypatch):
    from types import SimpleNamespace

    from trackside.session import shared_dir

    bare = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x")
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(bare)


def test_one_plan_over_many_files(spark):
    paths = [scratch_path(spark, f"car_data_{n}") for n in (1, 44)]
    spark.createDataFrame([(1, 300)], "driver_number long, speed long").write.parquet(paths[0])
    spark.createDataFrame([(44, 310, 1)], "driver_number long, speed long, drs long").write.parquet(paths[1])
    rows = bronze.read_files(spark, paths).collect()
    assert sorted((r.driver_number, r.speed, r.drs) for r in rows) == [(1, 300, None), (44, 310, 1)]


def test_failed_run_is_logged(spark):
    root = scratch_path(spark, "failed")
    with pytest.raises(FileNotFoundError):
        run_medallion(spark, root, 2023, "Nowhere", "Race")
    (run,) = read_table(spark, root, S.RUNS).collect()
    assert run.session_key == 0 and run.status.startswith("FAILED: no bronze sessions")


@pytest.fixture(scope="module")
def gateway(spark):
    def register(session):
        for name in ("dim_sessions", "dim_drivers"):
            session.createDataFrame(ROWS[name], S.CATALOG[name].schema).createOrReplaceTempView(name)

    return ReadOnlySql(spark, register)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT session_key, country_name FROM dim_sessions ORDER BY session_key",
        "WITH s AS (SELECT * FROM dim_sessions) SELECT session_key, country_name FROM s; ",
        "SELECT session_key, country_name AS created_by FROM dim_sessions -- updated",
        "SELECT session_key, country_name AS identifier FROM dim_sessions WHERE 'spark_catalog.reflect' <> 'java_method'",
        "SELECT session_key, country_name FROM IDENTIFIER('dim_' || 'sessions') CROSS JOIN range(1)",
        "SELECT session_key, country_name FROM dim_sessions WHERE session_key IN (SELECT max(session_key) FROM dim_sessions)",
    ],
)
def test_gateway_reads(gateway, text):
    (row,) = gateway.query(text).collect()
    assert tuple(row) == (10014, "Harbour")


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE dim_sessions",
        "INSERT INTO dim_sessions SELECT * FROM dim_sessions",
        "WITH s AS (SELECT 1) INSERT INTO dim_sessions SELECT * FROM s",
        "SET spark.sql.ansi.enabled=false",
        "TRUNCATE TABLE dim_sessions",
        "CREATE TABLE t AS SELECT 1",
        "SELECT * FROM dim_sessions) ; DROP TABLE dim_sessions",
        "SELECT 1; SELECT 2",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
        "SELECT * FROM spark_catalog.default.t",
        "SELECT * FROM spark_catalog /* */ .default.t",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT `java_method` /* */ ('java.lang.System', 'getenv', 'HOME')",
        "SELECT * FROM IDENTIFIER('spark_' || 'catalog.default.t')",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getenv', 'HOME')",
        "SELECT try_reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT session_key FROM dim_sessions ORDER BY upper(reflect('java.lang.System', 'getenv', 'HOME'))",
        "SELECT * FROM dim_sessions WHERE session_key = (SELECT max(length(java_method('java.lang.System', 'getenv', 'HOME'))))",
        "SELECT * FROM dim_sessions WHERE EXISTS (SELECT 1 FROM parquet.`/root/testdata/sf0.001/nation.parquet`)",
        "SELECT * FROM global_temp.hidden",
        "SELECT * FROM unknown_table",
    ],
)
def test_gateway_rejects(gateway, text):
    with pytest.raises(QueryRejected):
        gateway.query(text)
    assert gateway.query("SELECT * FROM dim_sessions").count() == 1


def test_archive(spark, tmp_path):
    folder = tmp_path / "year=2025" / "gp=Bahrain"
    folder.mkdir(parents=True)
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive" / "old.json").write_text("{}")
    for name, content in (("a.json", {"status": "green", "laps": 10}), ("b c+d.json", {"status": "yellow", "laps": 11})):
        (folder / name).write_text(json.dumps(content))
    (folder / "keep.txt").write_text("x")
    report = dicts(archive_json(spark, str(tmp_path)))
    assert report == [{"partition": "year=2025/gp=Bahrain", "files": 2}]
    assert sorted(os.listdir(folder)) == ["keep.txt"] and (tmp_path / "archive" / "old.json").exists()
    stored = spark.read.parquet(str(tmp_path / "archive" / "batch=*"))
    assert {r.file: json.loads(r.content)["laps"] for r in stored.collect()} == {"a.json": 10, "b c+d.json": 11}
    assert read_archive(spark, str(tmp_path / "archive")).count() == 2
    assert dicts(archive_json(spark, str(tmp_path))) == []


def test_reports(spark, tmp_path):
    for run, text in ((5, json.dumps({"evaluated_run_id": 5, "status": "completed"}, indent=4)), (9, json.dumps({"evaluated_run_id": 9})), (1, "{broken"), (0, json.dumps({"status": "x"}))):
        (tmp_path / f"ci_healing_report_{run}.json").write_text(text)
    full = {"evaluated_run_id": 7, "alert_triggered": "odd", "actions": [{"type": "mail", "to": ["a", "b"]}, "note"], "attempt": {"n": 2}}
    (tmp_path / "ci_healing_report_7.json").write_text(json.dumps(full))
    (tmp_path / "ci_healing_report_list.json").write_text("[1, 2]")
    found = read_reports(spark, str(tmp_path))
    rows = found.withColumn("whole", F.to_json("report")).withColumn("done", F.transform("actions", lambda a: F.to_json(a))).drop("report", "actions").collect()
    assert [r.evaluated_run_id for r in rows] == [9, 7, 5, 0]
    assert json.loads(rows[1].whole) == full and rows[1].alert_triggered is None  # unknown fields stay, other types are no value
    assert [json.loads(a) for a in rows[1].done] == full["actions"] and rows[0].done == []
    assert [r.evaluated_run_id for r in numbered(found).orderBy("position").collect()] == [9, 7, 5, 0]


def test_types_that_change_between_files(spark):
    root = scratch_path(spark, "mixed")
    batches = [
        ([(1, "+1.2 LAP", 1.5)], "driver_number int, gap string, x double"),
        ([(2, 7, 3)], "driver_number long, gap long, x int"),
        ([(3, None, 4.0, True)], "Driver_Number smallint, gap string, x float, late boolean"),
        ([(4, 9, 5)], "driver_number long, gap long, x int"),
    ]
    paths = [f"{root}/{n}" for n in range(len(batches))]
    for path, (rows, schema) in zip(paths, batches):
        spark.createDataFrame(rows, schema).write.parquet(path)
    found = bronze.read_files(spark, paths)
    assert dict(found.dtypes) == {"driver_number": "bigint", "gap": "string", "x": "double", "late": "boolean"}
    assert sorted(map(tuple, found.collect())) == [(1, "+1.2 LAP", 1.5, None), (2, "7", 3.0, None), (3, None, 4.0, True), (4, "9", 5.0, None)]
    with pytest.raises(Exception):
        spark.read.option("mergeSchema", "true").parquet(*paths).collect()


def test_bronze_batches_of_different_types(spark):
    root = scratch_path(spark, "bronze")
    land(spark, root, "weather", [(1, 20)], "session_key long, humidity long", gp="A")
    land(spark, root, "weather", [(2, "n/a")], "session_key long, humidity string", gp="B 2")
    rows = bronze.read_bronze(spark, root, "weather", 2025, None, "Race").collect()
    assert sorted((r.session_key, r.humidity, r._gp) for r in rows) == [(1, "20", "A"), (2, "n/a", "B_2")]
    with pytest.raises(FileNotFoundError):
        bronze.read_bronze(spark, root, "weather", 1999)


JOBS = "run_id long, jobs array<struct<name:string,steps:array<struct<name:string,conclusion:string>>>>"
RUNS = "id long, name string, status string, conclusion string, head_sha string"


def test_triage(spark):
    steps = [("Code Formatting Check (Black)", "failure"), ("Static Analysis & Lint (Flake8)", "success"), ("Run Unit & Integration Tests (Pytest)", "success")]
    jobs = spark.createDataFrame([(888, [("lint-and-test", steps)]), (777, [("j", [(None, "failure")])])], JOBS)
    runs = spark.createDataFrame(
        [(999, "CI", "completed", "success", "s1"), (888, "CI", "completed", "failure", "s2"), (777, None, "completed", "timed_out", None), (666, "CI", "completed", "cancelled", "s")],
        RUNS,
    )
    rows = {r["evaluated_run_id"]: r for r in dicts(triage(runs, jobs))}
    assert rows[999]["alert_triggered"] is False and rows[999]["failed_steps"] == []
    assert rows[888]["failed_steps"] == ["Code Formatting Check (Black)"]
    assert (rows[888]["format_failed"], rows[888]["lint_failed"], rows[888]["test_failed"]) == (True, False, False)
    assert rows[777]["failed_steps"] == ["Unknown Step"] and rows[777]["workflow_name"] == "Unknown Workflow"
    assert (rows[666]["format_failed"], rows[666]["lint_failed"], rows[666]["test_failed"]) == (True, True, True)
    assert flatten_steps(jobs).where("step_conclusion = 'failure'").count() == 2
    assert [r.id for r in pick_run(runs, ["id"], ["status"]).collect()] == [999]
    assert [r.id for r in pick_run(runs, ["id"], ["status"], run_id=777).collect()] == [777]
    assert [r.id for r in pick_run(runs, ["id"], ["status"], run_id=5).collect()] == [999]


def test_reports_are_opened_once(spark, tmp_path):
    """Sorting reads its rows twice: the second time they come from the shared folder, not from the many files."""
    for n in range(3):
        (tmp_path / f"ci_healing_report_{n}.json").write_text(json.dumps({"evaluated_run_id": n}))
    found = read_reports(spark, str(tmp_path))
    assert found.inputFiles() and all(f.endswith(".parquet") for f in found.inputFiles())
    assert [r.evaluated_run_id for r in found.collect()] == [2, 1, 0]
