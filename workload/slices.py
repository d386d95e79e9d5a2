"""Served reads as requests ask for them: one session, one or two drivers, rows in the order they are served.

A column ``position`` numbers the rows as they come out of the plan, so that the comparison sees the order. The
session is the earliest one, the driver the one with most events in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside.operators.numbering import numbered
from trackside.plans import served
from workload.registry import ORACLES, query
from workload.serving import TELEMETRY_POINTS, TRAJECTORY_POINTS, RacingViews

SESSION_SQL = "(SELECT min(weekofyear(ts)) + 9000 FROM events)"
_BUSY = f"SELECT user_id FROM events WHERE weekofyear(ts) + 9000 = {SESSION_SQL} GROUP BY user_id ORDER BY count(*) DESC, user_id"
DRIVER_SQL = f"({_BUSY} LIMIT 1)"
PAIR_SQL = f"({_BUSY} LIMIT 2)"


def one_of(name: str, order: str, *, driver: bool = False, columns: str = "*") -> str:
    """The slice of an all-sessions counterpart, numbered in the documented order."""
    where = f"session_key = {SESSION_SQL}" + (f" AND driver_number = {DRIVER_SQL}" if driver else "")
    keys = "session_key, driver_number" if driver else "session_key"
    picked = f"* EXCLUDE ({keys})" if columns == "*" else columns
    return f"SELECT {picked}, row_number() OVER (ORDER BY {order}) AS position FROM ({ORACLES[name]}) AS served WHERE {where}"


class Asked:
    """Views, and the parameters of the request."""

    def __init__(self, spark, sf_dir):
        self.views = RacingViews(spark, sf_dir)
        events = self.views._events()
        self.session = events.agg(F.min("session_key").alias("s")).head().s
        counts = events.where(F.col("session_key") == self.session).groupBy("driver_number").count()
        self.drivers = [r.driver_number for r in counts.orderBy(F.desc("count"), "driver_number").limit(2).collect()]


@query(
    "SELECT *, row_number() OVER (ORDER BY year DESC, country_name, session_key) AS position "
    f"FROM ({ORACLES['served_sessions']}) AS served"
)
def slice_sessions(spark, sf_dir):
    return numbered(served.sessions(RacingViews(spark, sf_dir)))


@query(one_of("served_drivers", "team_name, driver_number"))
def slice_drivers(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.drivers(asked.views, asked.session))


@query(one_of("served_intervals", "date", columns="date, gap_to_leader, interval"))
def slice_intervals(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.intervals(asked.views, asked.session)).select("date", "gap_to_leader", "interval", "position")


@query(one_of("served_pit_stops", "lap_number, pit_duration DESC NULLS LAST, date"))
def slice_pit_stops(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.pit_stops(asked.views, asked.session))


@query(one_of("served_weather", "date"))
def slice_weather(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.weather(asked.views, asked.session))


@query(one_of("served_stints", "driver, stint_number", columns="driver, stint_number"))
def slice_stints(spark, sf_dir):
    """Only the columns of the order: several stints share them."""
    asked = Asked(spark, sf_dir)
    return numbered(served.stints(asked.views, asked.session)).select("driver", "stint_number", "position")


@query(one_of("served_race_control", "date, message"))
def slice_race_control(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.race_control(asked.views, asked.session))


@query(one_of("served_overtakes", "date", columns="overtaking_driver, overtaken_driver, date"))
def slice_overtakes(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.overtakes(asked.views, asked.session))


@query(one_of("served_lap_predictions", "stint_number", driver=True, columns="stint_number"))
def slice_lap_predictions(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    rows = served.lap_predictions(asked.views, asked.session, asked.drivers[0])
    return numbered(rows).select("stint_number", "position")


@query(one_of("served_telemetry", "date", driver=True))
def slice_telemetry(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.telemetry(asked.views, asked.session, asked.drivers[0], points=TELEMETRY_POINTS))


_TRAJECTORY = ORACLES["served_duel_location"].replace("driver_number, x, y, speed", "driver_number, rn, x, y, speed")


@query(
    f"SELECT x, y, speed, gear, throttle, brake, row_number() OVER (ORDER BY rn) AS position FROM ({_TRAJECTORY}) AS served "
    f"WHERE session_key = {SESSION_SQL} AND driver_number = {DRIVER_SQL}"
)
def slice_duel_location(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return numbered(served.duel_location(asked.views, asked.session, asked.drivers[0], points=TRAJECTORY_POINTS))


@query(
    f"SELECT * EXCLUDE (session_key) FROM ({ORACLES['served_duel_metrics']}) AS served "
    f"WHERE session_key = {SESSION_SQL} AND driver_number IN {PAIR_SQL}"
)
def slice_duel_metrics(spark, sf_dir):
    asked = Asked(spark, sf_dir)
    return served.duel_metrics(asked.views, asked.session, asked.drivers)
