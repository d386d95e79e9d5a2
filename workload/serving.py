"""Served reads over a racing lakehouse whose tables are derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.functions.scalars import iso_micros
from trackside.operators.sampling import rank_rows
from trackside.plans import gold, served
from trackside.plans.medallion import align_telemetry
from trackside.session import scratch_path
from workload.registry import query, table
from workload.series import ISO
from workload.tables import K_SQL, k_of

TELEMETRY_POINTS = 4
TRAJECTORY_POINTS = 3


class RacingViews:
    """Sessions are calendar weeks, drivers are customers, events are what the cars report.

    A view is built when it is asked for, by the method of its name.
    """

    KEY = ["session_key", "driver_number"]
    COMPOUNDS = ["SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET", "soft"]

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _events(self, *kinds: str) -> DataFrame:
        events = self._table("events").select(
            "event_id",
            F.col("ts").alias("date"),
            F.col("user_id").alias("driver_number"),
            "event_type",
            "value",
            k_of().alias("k"),
            (F.weekofyear("ts") + 9000).cast("bigint").alias("session_key"),
        )
        return events.where(F.col("event_type").isin(*kinds)) if kinds else events

    def _compound(self):
        return F.array(*[F.lit(c) for c in self.COMPOUNDS])[(F.col("k") % 6).cast("int")].alias("compound")

    def dim_sessions(self) -> DataFrame:
        places = self._table("nation").join(self._table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        weeks = self._events().select("session_key").distinct()
        return weeks.join(places, F.col("n_nationkey") == F.col("session_key") - 9000).select(
            "session_key",
            F.lit(2024).cast("bigint").alias("year"),
            F.lit("Race").alias("session_name"),
            F.lit("Race").alias("session_type"),
            (F.col("session_key") - 9000).alias("circuit_key"),
            F.col("r_name").alias("circuit_short_name"),
            F.col("n_name").alias("country_name"),
        )

    def dim_drivers(self) -> DataFrame:
        return self._table("customer").select(
            F.col("c_custkey").alias("driver_number"),
            F.col("c_name").alias("full_name"),
            F.substring("c_mktsegment", 1, 3).alias("name_acronym"),
            F.col("c_mktsegment").alias("team_name"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country_code"),
        )

    def dim_stints(self) -> DataFrame:
        k = F.col("k")
        return self._events("signup").select(
            *self.KEY,
            k.alias("stint_number"),
            self._compound(),
            k.alias("lap_start"),
            F.when(k % 9 != 0, F.floor(F.col("value") / 4)).alias("lap_end"),
            (k % 5).alias("tyre_age_at_start"),
        )

    def dim_weather(self) -> DataFrame:
        k, value = F.col("k"), F.col("value")
        return self._events("view").select(
            "session_key",
            "date",
            (value / 10).alias("air_temperature"),
            (value / 8).alias("track_temperature"),
            k.cast("double").alias("humidity"),
            (value / 50).alias("wind_speed"),
            (k % 2).alias("rainfall"),
        )

    def fact_intervals(self) -> DataFrame:
        k = F.col("k")
        gap = F.when(k % 10 == 0, F.lit("None")).when(k % 10 != 1, F.concat(F.lit("+"), k.cast("string"), F.lit("s")))
        return self._events("view").select(
            *self.KEY,
            gap.alias("gap_to_leader"),
            F.concat(F.lit("+"), (k % 7).cast("string"), F.lit("s")).alias("interval"),
            "date",
        )

    def fact_pit_stops(self) -> DataFrame:
        value = F.col("value")
        return self._events("error").select(
            *self.KEY,
            F.col("k").alias("lap_number"),
            (value / 100).alias("stop_duration"),
            (value / 50).alias("lane_duration"),
            (value / 20).alias("pit_duration"),
            "date",
        )

    def fact_race_control(self) -> DataFrame:
        documents = self._table("documents").withColumnRenamed("doc_id", "event_id")
        return (
            self._events()
            .join(documents, "event_id")
            .select(
                "session_key",
                F.when(F.col("event_type") != "signup", F.col("driver_number")).alias("driver_number"),
                F.col("source").alias("category"),
                F.col("lang").alias("flag"),
                F.col("text").alias("message"),
                "date",
            )
        )

    def fact_overtakes(self) -> DataFrame:
        return self._events("error").select(
            "session_key",
            F.col("driver_number").alias("overtaking_driver_number"),
            F.floor(F.col("value") * 10).alias("overtaken_driver_number"),
            (F.col("k") % 20 + 1).alias("position"),
            "date",
        )

    def fact_session_results(self) -> DataFrame:
        totals = (
            self._events()
            .groupBy(*self.KEY)
            .agg(F.round(F.sum("value"), 2).alias("points"), F.count(F.lit(1)).alias("number_of_laps"))
            .withColumn("_behind", -F.col("points"))
        )
        placed = rank_rows(totals, by=["session_key"], order=["_behind", "driver_number"])
        return placed.select(*self.KEY, F.col("rn").alias("position"), "points", "number_of_laps")

    def fact_car_telemetry(self) -> DataFrame:
        k, value = F.col("k"), F.col("value")
        return self._events("click", "view").select(
            *self.KEY,
            "date",
            F.floor(value).alias("speed"),
            F.floor(value * 30).alias("rpm"),
            (k % 12 - 2).alias("n_gear"),
            k.cast("double").alias("throttle"),
            (100 - k).cast("double").alias("brake"),
            (k % 3).alias("drs"),
        )

    def fact_car_location(self) -> DataFrame:
        k = F.col("k")
        return self._events("purchase").select(
            *self.KEY,
            "date",
            F.when(k != 0, F.floor(F.col("value") * 10)).alias("x"),
            (k * 10).alias("y"),
            F.col("event_id").alias("z"),
        )

    def gold_lap_predictions(self) -> DataFrame:
        k, value = F.col("k"), F.col("value")
        return self._events("signup").select(
            *self.KEY,
            (k % 7).alias("stint_number"),
            k.alias("lap_number"),
            self._compound(),
            (k % 5).alias("tyre_age_at_start"),
            (value / 10 + 85).alias("lap_duration_seconds"),
            (k / 10 + 85).alias("predicted_lap_duration_seconds"),
            (value / 10 - k / 10).alias("delta_performance_seconds"),
        )


COMPOUND_SQL = (
    "CASE k % 6 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' WHEN 3 THEN 'INTERMEDIATE' "
    "WHEN 4 THEN 'WET' ELSE 'soft' END"
)

# The same views in SQL, put in front of every counterpart below.
VIEWS_SQL = f"""
    e AS (SELECT event_id, ts AS date, user_id AS driver_number, event_type, value, {K_SQL} AS k,
                 CAST(week(ts) + 9000 AS BIGINT) AS session_key FROM events),
    dim_sessions AS (SELECT s.session_key, CAST(2024 AS BIGINT) AS year, 'Race' AS session_name, 'Race' AS session_type,
                            r_name AS circuit_short_name, n_name AS country_name
                     FROM (SELECT DISTINCT session_key FROM e) s JOIN nation ON n_nationkey = s.session_key - 9000
                     JOIN region ON n_regionkey = r_regionkey),
    dim_drivers AS (SELECT c_custkey AS driver_number, c_name AS full_name, substr(c_mktsegment, 1, 3) AS name_acronym,
                           c_mktsegment AS team_name, 'N' || c_nationkey AS country_code FROM customer),
    dim_stints AS (SELECT session_key, driver_number, k AS stint_number, {COMPOUND_SQL} AS compound, k AS lap_start,
                          CASE WHEN k % 9 <> 0 THEN CAST(floor(value / 4) AS BIGINT) END AS lap_end,
                          k % 5 AS tyre_age_at_start FROM e WHERE event_type = 'signup'),
    dim_weather AS (SELECT session_key, date, value / 10 AS air_temperature, value / 8 AS track_temperature,
                           CAST(k AS DOUBLE) AS humidity, value / 50 AS wind_speed, k % 2 AS rainfall
                    FROM e WHERE event_type = 'view'),
    fact_intervals AS (SELECT session_key, driver_number,
                              CASE WHEN k % 10 = 0 THEN 'None' WHEN k % 10 <> 1 THEN '+' || k || 's' END AS gap_to_leader,
                              '+' || (k % 7) || 's' AS interval, date FROM e WHERE event_type = 'view'),
    fact_pit_stops AS (SELECT session_key, driver_number, k AS lap_number, value / 100 AS stop_duration,
                              value / 50 AS lane_duration, value / 20 AS pit_duration, date
                       FROM e WHERE event_type = 'error'),
    fact_race_control AS (SELECT session_key, CASE WHEN event_type <> 'signup' THEN driver_number END AS driver_number,
                                 source AS category, lang AS flag, text AS message, date
                          FROM e JOIN documents ON doc_id = event_id),
    fact_overtakes AS (SELECT session_key, driver_number AS overtaking_driver_number,
                              CAST(floor(value * 10) AS BIGINT) AS overtaken_driver_number, k % 20 + 1 AS position, date
                       FROM e WHERE event_type = 'error'),
    totals AS (SELECT session_key, driver_number, round(sum(value), 2) AS points, count(*) AS number_of_laps
               FROM e GROUP BY ALL),
    fact_session_results AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY points DESC, driver_number)
                                    AS position FROM totals),
    fact_car_telemetry AS (SELECT session_key, driver_number, date, CAST(floor(value) AS BIGINT) AS speed,
                                  CAST(floor(value * 30) AS BIGINT) AS rpm, k % 12 - 2 AS n_gear,
                                  CAST(k AS DOUBLE) AS throttle, CAST(100 - k AS DOUBLE) AS brake, k % 3 AS drs
                           FROM e WHERE event_type IN ('click', 'view')),
    fact_car_location AS (SELECT session_key, driver_number, date,
                                 CASE WHEN k <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS x, k * 10 AS y,
                                 event_id AS z FROM e WHERE event_type = 'purchase'),
    gold_lap_predictions AS (SELECT session_key, driver_number, k % 7 AS stint_number, k AS lap_number,
                                    {COMPOUND_SQL} AS compound, k % 5 AS tyre_age_at_start,
                                    value / 10 + 85 AS lap_duration_seconds, k / 10 + 85 AS predicted_lap_duration_seconds,
                                    value / 10 - k / 10 AS delta_performance_seconds
                             FROM e WHERE event_type = 'signup')
"""


def over_views(select: str) -> str:
    return f"WITH {VIEWS_SQL}\n{select}"


@query(over_views("SELECT session_key, year, session_name, session_type, circuit_short_name, country_name FROM dim_sessions"))
def served_sessions(spark, sf_dir):
    return served.sessions(RacingViews(spark, sf_dir))


@query(
    over_views(
        """
        SELECT DISTINCT s.session_key, d.driver_number, d.full_name, d.team_name, d.name_acronym, d.country_code
        FROM dim_drivers d JOIN dim_stints s ON d.driver_number = s.driver_number
        """
    )
)
def served_drivers(spark, sf_dir):
    return served.drivers(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        SELECT i.session_key, d.name_acronym AS driver, d.team_name AS team, i.gap_to_leader, i.interval,
               strftime(i.date, {ISO}) AS date
        FROM fact_intervals i JOIN dim_drivers d ON i.driver_number = d.driver_number
        """
    )
)
def served_intervals(spark, sf_dir):
    return served.intervals(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        SELECT p.session_key, d.name_acronym AS driver, d.team_name AS team, p.lap_number, p.stop_duration,
               p.lane_duration, p.pit_duration, strftime(p.date, {ISO}) AS date
        FROM fact_pit_stops p JOIN dim_drivers d ON p.driver_number = d.driver_number
        """
    )
)
def served_pit_stops(spark, sf_dir):
    return served.pit_stops(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        SELECT session_key, strftime(date, {ISO}) AS date, air_temperature, track_temperature, humidity, wind_speed,
               rainfall FROM dim_weather
        """
    )
)
def served_weather(spark, sf_dir):
    return served.weather(RacingViews(spark, sf_dir))


@query(
    over_views(
        """
        SELECT s.session_key, d.name_acronym AS driver, d.team_name AS team, s.stint_number, s.compound, s.lap_start,
               s.lap_end, s.tyre_age_at_start
        FROM dim_stints s JOIN dim_drivers d ON s.driver_number = d.driver_number
        """
    )
)
def served_stints(spark, sf_dir):
    return served.stints(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        SELECT rc.session_key, d.name_acronym AS driver, rc.category, rc.flag, rc.message, strftime(rc.date, {ISO}) AS date
        FROM fact_race_control rc LEFT JOIN dim_drivers d ON rc.driver_number = d.driver_number
        """
    )
)
def served_race_control(spark, sf_dir):
    return served.race_control(RacingViews(spark, sf_dir))


@query(
    over_views(
        """
        SELECT r.session_key, d.name_acronym AS driver, d.full_name, d.team_name AS team, r.position, r.points,
               r.number_of_laps
        FROM fact_session_results r JOIN dim_drivers d ON r.driver_number = d.driver_number WHERE r.position = 1
        """
    )
)
def served_winner(spark, sf_dir):
    return served.winner(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        , m AS (SELECT session_key, min(date) AS t0 FROM fact_car_telemetry WHERE speed > 100 GROUP BY session_key),
        l AS (SELECT f.*, count(*) OVER (PARTITION BY f.session_key, f.driver_number) AS n
              FROM fact_car_location f JOIN m ON m.session_key = f.session_key AND f.date >= m.t0),
        a AS (SELECT l.*, t.speed, t.n_gear, t.throttle, t.brake,
                     row_number() OVER (PARTITION BY l.session_key, l.driver_number ORDER BY l.date) AS rn
              FROM l ASOF JOIN fact_car_telemetry t
                ON l.session_key = t.session_key AND l.driver_number = t.driver_number AND l.date >= t.date)
        SELECT session_key, driver_number, x, y, speed, n_gear AS gear, throttle, brake
        FROM a WHERE rn % greatest(1, n // {TRAJECTORY_POINTS}) = 0 AND x IS NOT NULL AND y IS NOT NULL
        """
    ).replace("\n\n        , m AS", ",\n m AS")
)
def served_duel_location(spark, sf_dir):
    return served.duel_location(RacingViews(spark, sf_dir), points=TRAJECTORY_POINTS)


@query(
    over_views(
        """
        SELECT t.session_key, t.driver_number, max(speed) AS max_speed, max(rpm) AS max_rpm,
               round(100.0 * count(*) FILTER (WHERE throttle > 90) / count(*), 1) AS full_throttle_pct,
               round(100.0 * count(*) FILTER (WHERE brake > 50) / count(*), 1) AS heavy_brake_pct,
               round(100.0 * count(*) FILTER (WHERE drs > 0) / count(*), 1) AS drs_pct,
               any_value(p.best_pit) AS best_pit
        FROM fact_car_telemetry t
        LEFT JOIN (SELECT session_key, driver_number, min(pit_duration) AS best_pit FROM fact_pit_stops GROUP BY ALL) p
          ON p.session_key = t.session_key AND p.driver_number = t.driver_number
        GROUP BY t.session_key, t.driver_number
        """
    )
)
def served_duel_metrics(spark, sf_dir):
    return served.duel_metrics(RacingViews(spark, sf_dir))


@query(
    over_views(
        """
        SELECT session_key, driver_number, stint_number, compound, tyre_age_at_start AS tyre_age,
               round(lap_duration_seconds, 3) AS actual_lap_time,
               round(predicted_lap_duration_seconds, 3) AS predicted_lap_time, round(delta_performance_seconds, 3) AS delta
        FROM gold_lap_predictions
        """
    )
)
def served_lap_predictions(spark, sf_dir):
    return served.lap_predictions(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        SELECT o.session_key, coalesce(a.name_acronym, CAST(o.overtaking_driver_number AS VARCHAR)) AS overtaking_driver,
               coalesce(b.name_acronym, CAST(o.overtaken_driver_number AS VARCHAR)) AS overtaken_driver, o.position,
               strftime(o.date, {ISO}) AS date
        FROM fact_overtakes o LEFT JOIN dim_drivers a ON o.overtaking_driver_number = a.driver_number
        LEFT JOIN dim_drivers b ON o.overtaken_driver_number = b.driver_number
        """
    )
)
def served_overtakes(spark, sf_dir):
    return served.overtakes(RacingViews(spark, sf_dir))


@query(
    over_views(
        f"""
        , r AS (SELECT *, row_number() OVER (PARTITION BY session_key, driver_number ORDER BY date) AS rn,
                       count(*) OVER (PARTITION BY session_key, driver_number) AS n FROM fact_car_telemetry),
        s AS (SELECT *, CASE WHEN n > {TELEMETRY_POINTS} THEN CAST(n / {TELEMETRY_POINTS} AS INTEGER) ELSE 1 END AS step FROM r)
        SELECT session_key, driver_number, strftime(date, {ISO}) AS date, speed, rpm, n_gear, throttle, brake, drs
        FROM s WHERE rn % step = 0 AND rn / step <= {TELEMETRY_POINTS}
        """
    ).replace("\n\n        , r AS", ",\n r AS")
)
def served_telemetry(spark, sf_dir):
    return served.telemetry(RacingViews(spark, sf_dir), points=TELEMETRY_POINTS)


@query(over_views("SELECT date AS timestamp, air_temperature, track_temperature, humidity FROM dim_weather"))
def dashboard_weather(spark, sf_dir):
    rows = RacingViews(spark, sf_dir)["dim_weather"]
    return served.dashboard_weather(rows.withColumn("date", iso_micros(F.col("date"))))


@query(
    over_views(
        """
        SELECT DISTINCT d.full_name, d.team_name, d.name_acronym, i.gap_to_leader, i.interval
        FROM fact_intervals i JOIN dim_drivers d ON i.driver_number = d.driver_number
        WHERE i.gap_to_leader IS NOT NULL AND i.gap_to_leader <> 'None'
        ORDER BY ALL LIMIT 15
        """
    )
)
def dashboard_gaps(spark, sf_dir):
    v = RacingViews(spark, sf_dir)
    as_text = v["fact_intervals"].withColumn("driver_number", F.col("driver_number").cast("string"))
    return served.dashboard_gaps(as_text, v["dim_drivers"])


@query(over_views("SELECT DISTINCT driver_number, full_name, team_name, country_code FROM dim_drivers"))
def dashboard_grid(spark, sf_dir):
    return served.dashboard_grid(RacingViews(spark, sf_dir)["dim_drivers"])


@query(
    over_views(
        f"""
        SELECT strftime(date, {ISO}) AS date, speed, rpm, n_gear FROM fact_car_telemetry
        ORDER BY fact_car_telemetry.date, speed, rpm, n_gear LIMIT 500
        """
    )
)
def dashboard_telemetry(spark, sf_dir):
    rows = served.dashboard_telemetry(RacingViews(spark, sf_dir)["fact_car_telemetry"])
    return rows.withColumn("date", iso_micros(F.col("date")))


@query(
    over_views(
        f"""
        SELECT l.session_key, l.driver_number, strftime(l.date, {ISO}) AS date, l.x, l.y, l.z, t.speed, t.rpm,
               CASE WHEN t.n_gear BETWEEN -1 AND 8 THEN t.n_gear ELSE 0 END AS n_gear, t.throttle, t.brake, t.drs
        FROM fact_car_location l ASOF JOIN fact_car_telemetry t
          ON l.session_key = t.session_key AND l.driver_number = t.driver_number AND l.date >= t.date
        """
    )
)
def silver_alignment(spark, sf_dir):
    """Positions with the car data in force, as published to silver."""
    v = RacingViews(spark, sf_dir)
    aligned = align_telemetry(v["fact_car_location"], v["fact_car_telemetry"])
    return aligned.withColumn("date", iso_micros(F.col("date")))


_FEATURES_SQL = """
    , base AS (SELECT session_key, driver_number, CAST(max(speed) AS DOUBLE) AS max_speed, CAST(max(rpm) AS DOUBLE) AS max_rpm,
                      100.0 * count(*) FILTER (WHERE throttle > 90) / count(*) AS throttle_intensity_pct,
                      100.0 * count(*) FILTER (WHERE brake > 50) / count(*) AS brake_intensity_pct
               FROM fact_car_telemetry GROUP BY ALL),
    ends AS (SELECT *, CASE WHEN coalesce(lap_end, lap_start + 10) < lap_start THEN lap_start + 5
                            ELSE coalesce(lap_end, lap_start + 10) END AS stop FROM dim_stints),
    laps AS (SELECT *, unnest(generate_series(lap_start, stop)) AS lap_number FROM ends)
    SELECT l.session_key, l.driver_number, l.stint_number, l.lap_number, l.compound,
           CASE upper(l.compound) WHEN 'SOFT' THEN 1.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'HARD' THEN 3.0
                WHEN 'INTERMEDIATE' THEN 4.0 WHEN 'WET' THEN 5.0 ELSE 2.0 END::DOUBLE AS compound_num,
           l.tyre_age_at_start + l.lap_number - l.lap_start AS tyre_age_at_start, b.max_speed, b.max_rpm,
           round(b.throttle_intensity_pct, 6) AS throttle_intensity_pct,
           round(b.brake_intensity_pct, 6) AS brake_intensity_pct,
           round(85.0 + CASE l.compound WHEN 'MEDIUM' THEN 0.8 WHEN 'HARD' THEN 1.8 WHEN 'INTERMEDIATE' THEN 5.0
                                        WHEN 'WET' THEN 5.0 ELSE 0.0 END
                 + (l.tyre_age_at_start + l.lap_number - l.lap_start) * 0.12::DOUBLE + (330.0 - b.max_speed) * 0.05, 6)
             AS lap_duration_seconds
    FROM laps l JOIN base b ON b.session_key = l.session_key AND b.driver_number = l.driver_number
"""


def _features(spark, sf_dir):
    v = RacingViews(spark, sf_dir)
    return gold.lap_features(v["dim_stints"], v["fact_car_telemetry"])


@query(over_views("").rstrip() + _FEATURES_SQL.replace("\n    , base", ",\n base", 1))
def lap_features(spark, sf_dir):
    rounded = ["throttle_intensity_pct", "brake_intensity_pct", "lap_duration_seconds"]
    return _features(spark, sf_dir).withColumns({c: F.round(c, 6) for c in rounded})


@query(
    "SELECT count(*) AS n, count(*) AS predicted, true AS delta_is_difference, true AS mean_is_a_lap_time, "
    "true AS inside_labels, true AS reloaded_is_equal FROM ("
    + over_views("").rstrip()
    + _FEATURES_SQL.replace("\n    , base", ",\n base", 1)
    + ")"
)
def lap_model_predict(spark, sf_dir):
    """The full forest trained on every lap, saved, loaded and applied: what must hold of its predictions.

    A forest is not compared value by value; a mean of labels can not leave their range, whatever the trees.
    """
    path = scratch_path(spark, "laps")
    _features(spark, sf_dir).write.parquet(f"{path}/features")
    features = spark.read.parquet(f"{path}/features")
    model = gold.train_regressor(features)
    gold.save_model(model, f"{path}/model")
    label, predicted = F.col("lap_duration_seconds"), F.col("predicted_lap_duration_seconds")
    fresh = model.transform(features).agg(F.sum(predicted).alias("fresh_sum"))
    found = gold.predict_delta(gold.load_model(f"{path}/model"), features).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(predicted).alias("predicted"),
        F.max(F.abs(F.col("delta_performance_seconds") - (label - predicted))).alias("apart"),
        F.avg(predicted).alias("mean"),
        F.min(predicted).alias("low"),
        F.max(predicted).alias("high"),
        F.min(label).alias("label_low"),
        F.max(label).alias("label_high"),
        F.sum(predicted).alias("sum"),
    )
    slack = 1e-9
    return found.join(fresh).select(
        "n",
        "predicted",
        (F.col("apart") < slack).alias("delta_is_difference"),
        F.col("mean").between(50, 250).alias("mean_is_a_lap_time"),
        ((F.col("low") >= F.col("label_low") - slack) & (F.col("high") <= F.col("label_high") + slack)).alias("inside_labels"),
        (F.abs(F.col("sum") - F.col("fresh_sum")) <= slack * F.abs(F.col("sum"))).alias("reloaded_is_equal"),
    )
