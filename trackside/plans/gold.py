"""Lap features, the lap-time regressor and its predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside import constants as K
from trackside.functions.scalars import base_lap_seconds, clamp, compound_code, compound_penalty, pct_true
from trackside.operators.tables import expand_range
from trackside.specs import LAP_FEATURES as LAP_SPEC


def telemetry_profile(telemetry: DataFrame) -> DataFrame:
    """Peak values and pedal shares per session and driver."""
    return telemetry.groupBy("session_key", "driver_number").agg(
        F.max("speed").cast("double").alias("max_speed"),
        F.max("rpm").cast("double").alias("max_rpm"),
        clamp(pct_true(F.col("throttle") > K.FULL_THROTTLE), 0.0, 100.0).alias("throttle_intensity_pct"),
        clamp(pct_true(F.col("brake") > K.HEAVY_BRAKE), 0.0, 100.0).alias("brake_intensity_pct"),
    )


def lap_features(stints: DataFrame, telemetry: DataFrame, lap_times: DataFrame | None = None) -> DataFrame:
    """One row per lap of every stint whose driver has telemetry.

    The label is the deterministic baseline, or the measured time where ``lap_times``
    (session_key, driver_number, lap_number, lap_duration_seconds) has one.
    """
    laps = expand_range(stints, "lap_start", "lap_end", index="_lap", value="lap_number").join(
        telemetry_profile(telemetry), ["session_key", "driver_number"]
    )
    age = F.col("tyre_age_at_start") + F.col("_lap")
    baseline = (
        base_lap_seconds(F.col("session_key"))
        + compound_penalty(F.col("compound"))
        + age * K.WEAR_SECONDS_PER_LAP
        + (F.lit(K.REFERENCE_SPEED) - F.col("max_speed")) * K.SECONDS_PER_SPEED_UNIT
    )
    rows = laps.withColumns(
        {
            "compound_num": compound_code(F.col("compound")),
            K.LAP_LABEL: baseline,
            "tyre_age_at_start": age,
        }
    )
    if lap_times is not None:
        keys = ["session_key", "driver_number", "lap_number"]
        measured = lap_times.select(*keys, F.col(K.LAP_LABEL).alias("_measured"))
        rows = rows.join(measured, keys, "left").withColumn(K.LAP_LABEL, F.coalesce("_measured", K.LAP_LABEL))
    return rows.select(*LAP_SPEC.schema.fieldNames())


def train_regressor(
    df: DataFrame,
    features: list[str] = K.LAP_FEATURES,
    label: str = K.LAP_LABEL,
    *,
    trees: int = K.FOREST_TREES,
    depth: int = 10,
    seed: int = K.FOREST_SEED,
) -> PipelineModel | None:
    """A random forest over all features per split; None with too few rows to train on."""
    rows = df.select(*features, label).dropna()
    if rows.limit(K.MIN_TRAINING_ROWS).count() < K.MIN_TRAINING_ROWS:
        return None
    forest = RandomForestRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol=f"predicted_{label}",
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="all",
        seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), forest]).fit(rows)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_delta(
    model: PipelineModel, df: DataFrame, features: list[str] = K.LAP_FEATURES, label: str = K.LAP_LABEL
) -> DataFrame:
    """Predictions and actual minus predicted; both NULL where a feature is unknown."""
    known = F.expr(" and ".join(f"`{c}` is not null" for c in features))
    predicted = F.col(f"predicted_{label}")
    applied = model.transform(df.where(known)).drop("_features")
    unknown = df.where(~known).withColumn(f"predicted_{label}", F.lit(None).cast("double"))
    return applied.unionByName(unknown).withColumn("delta_performance_seconds", F.col(label) - predicted)
