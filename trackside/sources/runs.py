"""Append-only run history."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.sources.lakehouse import table_path
from trackside.specs import RUNS

STATUS_TEXT_LENGTH = 100


def run_record(name: str, session_key: int | None, seconds: float, rows: int, error: Exception | None = None) -> dict:
    status = "SUCCESS" if error is None else f"FAILED: {str(error)[:STATUS_TEXT_LENGTH]}"
    return {
        "run_id": str(uuid.uuid4()),
        "pipeline_name": name,
        "session_key": int(session_key or 0),
        "execution_timestamp": datetime.now(timezone.utc).replace(tzinfo=None).isoformat(),
        "duration_seconds": float(seconds),
        "status": status,
        "total_rows_processed": 0 if error is not None else int(rows),
    }


def log_runs(spark: SparkSession, root: str, record: dict, sessions: DataFrame | None = None) -> None:
    """Append the record, once per session of ``sessions`` when given.

    A column ``total_rows_processed`` there holds the rows of each session, which are added up.
    """
    row = spark.createDataFrame([tuple(record[f] for f in RUNS.schema.fieldNames())], RUNS.schema)
    if sessions is not None:
        total = F.lit(record["total_rows_processed"]).cast("bigint").alias("total_rows_processed")
        if "total_rows_processed" in sessions.columns:
            total = F.sum("total_rows_processed").alias("total_rows_processed")
        else:
            total = F.first(total).alias("total_rows_processed")
        values = {f: F.lit(v) for f, v in record.items() if f not in ("session_key", "total_rows_processed")}
        row = sessions.groupBy("session_key").agg(total).withColumns(values)
    row.repartition("session_key").write.mode("append").partitionBy("session_key").parquet(table_path(root, RUNS.name))
