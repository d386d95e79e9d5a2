"""Time-series operators on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackside.functions.scalars import clean_gear, iso_micros, micros, pct_true
from trackside.operators.asof import asof_join
from trackside.operators.interval import Measure, interval_aggregate
from trackside.operators.sampling import downsample, rank_rows
from workload.registry import query, table

DAY = 86_400 * 1_000_000
ISO = "'%Y-%m-%dT%H:%M:%S.%f'"


def _events(spark, sf_dir, kind=None):
    events = table(spark, sf_dir, "events")
    return events if kind is None else events.where(F.col("event_type") == kind)


def _aligned(spark, sf_dir):
    """Latest click of the user at or before each of its purchases."""
    purchases = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts", "value")
    clicks = _events(spark, sf_dir, "click").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    return asof_join(purchases, clicks, by=["user_id"], on="ts", tie_break=["click_id"])


_ASOF = """
    SELECT l.event_id, l.user_id, l.ts, l.value, r.event_id AS click_id, r.value AS click_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') r
      ON l.user_id = r.user_id AND l.ts >= r.ts
"""


@query(_ASOF)
def asof_join_purchases(spark, sf_dir):
    return _aligned(spark, sf_dir)


@query(
    """
    SELECT l.event_id, l.user_id, r.event_id AS click_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r
      ON l.user_id = r.user_id AND l.ts >= r.ts
    """
)
def asof_join_left(spark, sf_dir):
    purchases = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    clicks = _events(spark, sf_dir, "click").select("user_id", "ts", F.col("event_id").alias("click_id"))
    joined = asof_join(purchases, clicks, by=["user_id"], on="ts", tie_break=["click_id"], how="left")
    return joined.select("event_id", "user_id", "click_id")


@query(
    f"""
    WITH a AS ({_ASOF}),
    g AS (SELECT user_id, click_value,
                 CASE WHEN CAST(floor(click_value / 40) AS BIGINT) - 2 BETWEEN -1 AND 8
                      THEN CAST(floor(click_value / 40) AS BIGINT) - 2 ELSE 0 END AS gear
          FROM a)
    SELECT user_id, count(*) AS n, max(click_value) AS max_value,
           round(avg(CASE WHEN click_value > 90 THEN 1.0 ELSE 0.0 END) * 100, 4) AS high_pct,
           CAST(sum(gear) AS BIGINT) AS gear_sum
    FROM g GROUP BY user_id
    """
)
def asof_clean_agg(spark, sf_dir):
    gear = clean_gear(F.floor(F.col("click_value") / 40) - 2)
    return (
        _aligned(spark, sf_dir)
        .withColumn("gear", gear)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("click_value").alias("max_value"),
            F.round(pct_true(F.col("click_value") > 90), 4).alias("high_pct"),
            F.sum("gear").alias("gear_sum"),
        )
    )


_MEASURES = [
    Measure("n", "count"),
    Measure("avg_value", "avg", "value"),
    Measure("max_value", "max", "value"),
    Measure("min_value", "min", "value"),
]


@query(
    """
    SELECT e.event_id, e.user_id, count(s.event_id) AS n, round(avg(s.value), 9) AS avg_value,
           max(s.value) AS max_value, min(s.value) AS min_value
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s
      ON s.user_id = e.user_id AND s.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOURS
    GROUP BY e.event_id, e.user_id
    """
)
def interval_join_agg(spark, sf_dir):
    """Purchases of the same user in the six hours after each error."""
    joined = interval_aggregate(
        _events(spark, sf_dir, "error").select("event_id", "user_id", "ts"),
        _events(spark, sf_dir, "purchase").select("user_id", "ts", "value"),
        by=["user_id"],
        event_ts="ts",
        series_ts="ts",
        after_seconds=6 * 3600,
        measures=_MEASURES,
    )
    return joined.drop("ts").withColumn("avg_value", F.round("avg_value", 9))


@query(
    """
    SELECT e.event_id, count(*) AS n, round(avg(s.value), 9) AS avg_value,
           max(s.value) AS max_value, min(s.value) AS min_value
    FROM (SELECT * FROM events WHERE event_type = 'error') e
    JOIN events s ON s.ts BETWEEN e.ts AND e.ts + INTERVAL 15 MINUTES
    GROUP BY e.event_id
    """
)
def interval_join_global(spark, sf_dir):
    """Everything that happened in the quarter hour after each error, whoever did it."""
    joined = interval_aggregate(
        _events(spark, sf_dir, "error").select("event_id", "ts"),
        _events(spark, sf_dir).select("ts", "value"),
        by=[],
        event_ts="ts",
        series_ts="ts",
        after_seconds=15 * 60,
        measures=_MEASURES,
        how="inner",
    )
    return joined.drop("ts").withColumn("avg_value", F.round("avg_value", 9))


@query(
    """
    WITH r AS (SELECT event_id, user_id,
                      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                      count(*) OVER (PARTITION BY user_id) AS n FROM events),
    s AS (SELECT *, CASE WHEN n > 20 THEN CAST(n / 20 AS INTEGER) ELSE 1 END AS step FROM r)
    SELECT event_id, user_id, rn FROM s WHERE rn % step = 0 AND rn / step <= 20
    """
)
def downsample_capped(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    kept = downsample(events, by=["user_id"], order=["ts", "event_id"], target=20, cap=20)
    return kept.select("event_id", "user_id", "rn")


@query(
    """
    WITH r AS (SELECT event_id, event_type,
                      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
                      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_id, event_type, rn FROM r WHERE rn % greatest(1, n // 700) = 0
    """
)
def downsample_floor(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "event_type", "ts")
    kept = downsample(events, by=["event_type"], order=["ts", "event_id"], target=700, rounding="floor", widths=[DAY])
    return kept.select("event_id", "event_type", "rn")


@query(
    """
    WITH m AS (SELECT user_id, min(ts) AS t0 FROM events WHERE value > 100 GROUP BY user_id),
    r AS (SELECT e.event_id, e.user_id,
                 row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS rn,
                 count(*) OVER (PARTITION BY e.user_id) AS n
          FROM events e JOIN m ON m.user_id = e.user_id AND e.ts >= m.t0)
    SELECT event_id, user_id, rn FROM r WHERE rn % greatest(1, n // 15) = 0
    """
)
def first_date_then_sample(spark, sf_dir):
    """From each user's first event above 100 on, about fifteen evenly spaced events."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    starts = events.where(F.col("value") > 100).groupBy("user_id").agg(F.min("ts").alias("t0"))
    later = events.join(starts, "user_id").where(F.col("ts") >= F.col("t0"))
    kept = downsample(later, by=["user_id"], order=["ts", "event_id"], target=15, rounding="floor")
    return kept.select("event_id", "user_id", "rn")


@query(
    f"""
    SELECT event_id, strftime(ts, {ISO}) AS at, strftime(ts + INTERVAL 15 SECONDS, {ISO}) AS until,
           epoch_us(ts) AS at_micros
    FROM events
    """
)
def iso_format(spark, sf_dir):
    ts = F.col("ts")
    return _events(spark, sf_dir).select(
        "event_id",
        iso_micros(ts).alias("at"),
        iso_micros(ts + F.expr("INTERVAL 15 SECONDS")).alias("until"),
        micros(ts).alias("at_micros"),
    )


@query(
    """
    SELECT l.event_id, max(r.event_id) AS click_id
    FROM (SELECT p.event_id, max(c.ts) AS ts
          FROM (SELECT * FROM events WHERE event_type = 'purchase') p
          ASOF JOIN (SELECT DISTINCT ts FROM events WHERE event_type = 'click') c ON p.ts >= c.ts
          GROUP BY p.event_id) l
    JOIN (SELECT * FROM events WHERE event_type = 'click') r ON r.ts = l.ts
    GROUP BY l.event_id
    """
)
def asof_hot_key(spark, sf_dir):
    """The latest click of anybody: all rows have one key and are spread along time."""
    purchases = _events(spark, sf_dir, "purchase").select("event_id", F.lit(1).alias("all"), "ts")
    clicks = _events(spark, sf_dir, "click").select(F.lit(1).alias("all"), "ts", F.col("event_id").alias("click_id"))
    joined = asof_join(purchases, clicks, by=["all"], on="ts", tie_break=["click_id"], bucket_seconds=7200)
    return joined.select("event_id", "click_id")


@query(
    """
    SELECT event_id, row_number() OVER (ORDER BY CAST(ts AS DATE), user_id, event_id) AS rn, count(*) OVER () AS n FROM events
    """
)
def rank_hot_instant(spark, sf_dir):
    """One key, few distinct days, many rows on each: ties are spread along the next columns."""
    events = _events(spark, sf_dir).select("event_id", "user_id", F.lit(1).alias("all"), F.to_date("ts").alias("day"))
    ranked = rank_rows(events, by=["all"], order=["day", "user_id", "event_id"], widths=[7, 100, 1000])
    return ranked.select("event_id", "rn", "n")


@query(
    """
    SELECT e.event_id, count(s.event_id) AS n, round(avg(s.value), 9) AS avg_value,
           max(s.value) AS max_value, min(s.value) AS min_value
    FROM (SELECT * FROM events WHERE event_type IN ('view', 'error')) e
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s
      ON s.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOURS
    GROUP BY e.event_id
    """
)
def interval_dense_events(spark, sf_dir):
    """Many events and rows of one key in every window, in buckets of ten minutes."""
    joined = interval_aggregate(
        _events(spark, sf_dir).where(F.col("event_type").isin("view", "error")).select("event_id", "ts"),
        _events(spark, sf_dir, "purchase").select("ts", "value"),
        by=[],
        event_ts="ts",
        series_ts="ts",
        after_seconds=6 * 3600,
        slices=36,
        measures=_MEASURES,
    )
    return joined.drop("ts").withColumn("avg_value", F.round("avg_value", 9))
