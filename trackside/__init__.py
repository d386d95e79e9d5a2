"""Trackside: keyed time series and racing telemetry on PySpark DataFrames."""

from trackside.operators.asof import asof_join
from trackside.operators.interval import Measure, interval_aggregate
from trackside.operators.quality import quality_report
from trackside.operators.sampling import downsample, rank_rows
from trackside.operators.tables import dedup_first, expand_range, latest, match_or_all, union_all, upsert
from trackside.operators.textsearch import tfidf, tfidf_match
from trackside.operators.validate import split_valid, validate
from trackside.plans.gateway import ReadOnlySql
from trackside.plans.gold import lap_features, load_model, predict_delta, save_model, train_regressor
from trackside.plans.hybrid import hybrid_search
from trackside.plans.medallion import run_gold, run_medallion
from trackside.session import configure
from trackside.sources.archive import archive_json
from trackside.sources.bronze import land_bronze, read_bronze
from trackside.sources.lakehouse import publish, published, register_lakehouse, replace_partitions

__all__ = [
    "Measure",
    "ReadOnlySql",
    "archive_json",
    "asof_join",
    "configure",
    "dedup_first",
    "downsample",
    "expand_range",
    "hybrid_search",
    "interval_aggregate",
    "land_bronze",
    "lap_features",
    "latest",
    "load_model",
    "match_or_all",
    "predict_delta",
    "publish",
    "published",
    "quality_report",
    "rank_rows",
    "read_bronze",
    "register_lakehouse",
    "replace_partitions",
    "run_gold",
    "run_medallion",
    "save_model",
    "split_valid",
    "tfidf",
    "tfidf_match",
    "train_regressor",
    "union_all",
    "upsert",
    "validate",
]
