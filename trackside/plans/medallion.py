"""Bronze to silver to gold."""

from __future__ import annotations

import time
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside import specs as S
from trackside.constants import FOCUS_DRIVERS, SEASON_FALLBACK
from trackside.functions.scalars import clean_gear
from trackside.operators.asof import asof_join
from trackside.operators.tables import dedup_first, latest
from trackside.operators.validate import Routed, route_valid
from trackside.plans import gold
from trackside.session import materialise
from trackside.sources import bronze
from trackside.sources.lakehouse import publish, published, read_table, store, table_path
from trackside.sources.runs import log_runs, run_record

# Tables that are validated and stored one by one; car data and location are aligned after.
PLAIN = [
    S.SESSIONS,
    S.DRIVERS,
    S.RACE_CONTROL,
    S.PIT_STOPS,
    S.STINTS,
    S.WEATHER,
    S.INTERVALS,
    S.SESSION_RESULTS,
    S.OVERTAKES,
]
_KEYS = [f"_{k}" for k in bronze.PARTITION]


def align_telemetry(location: DataFrame, car_data: DataFrame) -> DataFrame:
    """Each position with the car data in force; gears outside the plausible range become 0."""
    measured = ["speed", "rpm", "n_gear", "throttle", "brake", "drs"]
    key = ["session_key", "driver_number"]
    joined = asof_join(
        location.select(*key, "date", "x", "y", "z"),
        car_data,
        by=key,
        on="date",
        right_cols=measured,
        tie_break=measured,
    )
    return joined.withColumn("n_gear", clean_gear(F.col("n_gear")))


class SilverRun:
    """One batch: a single partition of bronze, or all events of a season (``gp=None``)."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        year: int,
        gp: str | None,
        session: str,
        focus: Iterable[int] = FOCUS_DRIVERS,
        lenient: bool = False,
    ):
        self.spark, self.root, self.session, self.gp = spark, root, session.replace(" ", "_"), gp
        self.focus, self.lenient = list(focus), lenient
        self.counts = {"read": 0, "valid": 0, "quarantined": 0}
        self._written: list[DataFrame] = []
        self._sessions: DataFrame | None = None
        self.year = self._season(year)

    def _batch(self, kind: str) -> DataFrame:
        return bronze.read_bronze(self.spark, self.root, kind, self.year, self.gp, self.session)

    def _season(self, year: int) -> int:
        for candidate in (year, SEASON_FALLBACK.get(year)):
            if candidate and bronze.has_bronze(self.spark, self.root, "sessions", candidate, self.gp, self.session):
                return candidate
        raise FileNotFoundError(f"no bronze sessions for {year} / {self.gp or 'all events'} / {self.session}")

    def _checked(self, spec: S.TableSpec) -> Routed | None:
        """Validated rows of one record kind and its quarantine; None where nothing has landed."""
        if not bronze.has_bronze(self.spark, self.root, spec.bronze, self.year, self.gp, self.session):
            return None
        rows = self._batch(spec.bronze)
        if self.lenient:
            spec = S.relaxed(spec)
            if spec.name == S.OVERTAKES.name and "position" in rows.columns:
                rows = rows.withColumn("position", F.coalesce("position", F.lit(0)))
            if spec.name == S.DRIVERS.name:
                rows = dedup_first(rows, ["driver_number"], _KEYS)
        return route_valid(rows, spec, f"{spec.name}: contract not met")

    def _finish(self, spec: S.TableSpec, checked) -> None:
        """Add up the counters of a written table and quarantine its bad rows, if any."""
        for name in self.counts:
            self.counts[name] += checked.counts[name]
        if checked.counts["quarantined"]:
            bronze.write_quarantine(checked.quarantine, self.root, spec.bronze)

    def run(self) -> dict[str, int]:
        for spec in PLAIN:
            checked = self._checked(spec)
            if checked is not None:
                rows = checked.valid
                if spec.keys:
                    # As if the events were published one after the other, in order of their name.
                    rows = latest(rows, list(spec.keys), ["_gp"])
                store(self.spark, self.root, spec, rows.drop(*_KEYS))
                self._finish(spec, checked)
                self._count(spec, checked.valid)
        self._telemetry()
        return self.counts

    def _telemetry(self) -> None:
        car, location = self._checked(S.CAR_DATA), self._checked(S.LOCATION)
        if car is None or location is None:
            return
        followed = F.col("driver_number").isin(self.focus)
        store(self.spark, self.root, S.LOCATION, location.valid.where(followed).drop(*_KEYS))
        self._finish(S.LOCATION, location)
        self._count(S.LOCATION, location.valid)
        stored = read_table(self.spark, self.root, S.LOCATION)
        bad = location.quarantine.select(F.col("session_key").try_cast("bigint")) if "session_key" in location.quarantine.columns else None
        batch = location.valid.select("session_key")
        batch = (batch if bad is None else batch.unionAll(bad)).distinct()
        positions = stored.join(batch, "session_key", "left_semi")
        aligned = align_telemetry(positions, car.valid.where(followed))
        store(self.spark, self.root, S.TELEMETRY, aligned)
        self._finish(S.CAR_DATA, car)
        self._count(S.TELEMETRY, aligned)

    def sessions(self) -> DataFrame:
        """(session_key, _gp) of the batch; a row per session, read once."""
        if self._sessions is None:
            keys = self._batch("sessions").select(F.col("session_key").try_cast("bigint").alias("session_key"), "_gp")
            self._sessions = materialise(keys.where(F.col("session_key").isNotNull()).distinct(), "sessions")
        return self._sessions

    def _count(self, spec: S.TableSpec, valid: DataFrame) -> None:
        """Rows written of each session: read off the stored partitions; tables without a session key (drivers, a
        few rows per event) by the event they came with."""
        sessions, number = self.sessions(), F.count(F.lit(1)).alias("total_rows_processed")
        if "session_key" in spec.schema.fieldNames():
            stored = read_table(self.spark, self.root, spec)
            rows = stored.groupBy("session_key").agg(number).join(sessions.select("session_key").distinct(), "session_key")
        else:
            rows = valid.groupBy("_gp").agg(number).join(sessions, "_gp").drop("_gp")
        self._written.append(rows.select("session_key", "total_rows_processed"))

    def written(self) -> DataFrame:
        """(session_key, total_rows_processed): rows per session and table; 0 for a session without any."""
        none = self.sessions().select("session_key", F.lit(0).cast("bigint").alias("total_rows_processed"))
        return reduce(DataFrame.unionByName, self._written, none)


def run_gold(spark: SparkSession, root: str, lap_times: DataFrame | None = None, **forest) -> int:
    """Lap features, model and predictions from what silver holds; returns the feature rows."""
    features = gold.lap_features(
        read_table(spark, root, S.STINTS), read_table(spark, root, S.TELEMETRY), lap_times
    )
    path = table_path(root, S.LAP_FEATURES.name)
    publish(spark, features, path)
    stored = published(spark, path)
    model = gold.train_regressor(stored, **forest)
    if model is not None:
        gold.save_model(model, f"{root.rstrip('/')}/models/lap_regressor")
        publish(spark, gold.predict_delta(model, stored), table_path(root, S.LAP_PREDICTIONS.name))
    return stored.count()


def run_medallion(
    spark: SparkSession,
    root: str,
    year: int,
    gp: str | None,
    session: str = "Race",
    *,
    with_gold: bool = True,
    lap_times: DataFrame | None = None,
    forest: dict | None = None,
    **options,
) -> dict[str, int]:
    """The whole batch, with its outcome appended to the run history either way."""
    started, run = time.time(), None
    name = f"silver_{(gp or 'all').replace(' ', '_')}_{session.replace(' ', '_')}"
    try:
        run = SilverRun(spark, root, year, gp, session, **options)
        counts = run.run()
        if with_gold:
            run_gold(spark, root, lap_times, **(forest or {}))
        log_runs(spark, root, run_record(name, None, time.time() - started, 0), run.written())
        return counts
    except Exception as error:
        # Under the sessions' own keys, if they were known by then.
        keys = None if run is None else run.sessions().select("session_key")
        log_runs(spark, root, run_record(name, None, time.time() - started, 0, error), keys)
        raise
