"""Nested build-job payloads and stored build reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackside.session import materialise

JOBS_SCHEMA = "array<struct<name:string,steps:array<struct<name:string,conclusion:string>>>>"
# The fields of a report and their types.
REPORT_FIELDS = {
    "evaluated_run_id": "bigint",
    "workflow_name": "string",
    "status": "string",
    "conclusion": "string",
    "commit_sha": "string",
    "alert_triggered": "boolean",
    "auto_healing_executed": "boolean",
}
REPORT_FILES = "ci_healing_report_*.json"


def flatten_steps(df: DataFrame, jobs: str = "jobs") -> DataFrame:
    """One row per step of every job: the other columns plus job, step and conclusion."""
    keep = [c for c in df.columns if c != jobs]
    per_job = df.select(*keep, F.explode(jobs).alias("_job"))
    per_step = per_job.select(*keep, F.col("_job.name").alias("job"), F.explode("_job.steps").alias("_step"))
    return per_step.select(
        *keep,
        "job",
        F.coalesce("_step.name", F.lit("Unknown Step")).alias("step"),
        F.col("_step.conclusion").alias("step_conclusion"),
    )


def read_reports(spark: SparkSession, folder: str, files: str = REPORT_FILES) -> DataFrame:
    """Stored reports, one to a file, newest run first and equal runs by file name.

    Columns: the known fields, NULL where a report lacks one or has it with another type (a missing id counts as 0),
    ``actions`` as an array of variants, ``report``, the whole document as a variant with the fields nobody has
    declared, and ``file``. Files that are no JSON object are skipped. Every file is opened once: what they hold is kept in the
    shared folder, as sorting takes a sample first.
    """
    texts = spark.read.option("pathGlobFilter", files).text(folder, wholetext=True)
    texts = texts.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))  # small files: a task opens many
    found = texts.select(F.try_parse_json("value").alias("report"), F.col("_metadata.file_name").alias("file"))
    found = materialise(found.where(F.schema_of_variant("report").startswith("OBJECT")), "found")
    known = {name: F.try_variant_get("report", f"$.{name}", kind) for name, kind in REPORT_FIELDS.items()}
    known["evaluated_run_id"] = F.coalesce(known["evaluated_run_id"], F.lit(0).cast("bigint"))
    actions = F.coalesce(F.try_variant_get("report", "$.actions", "array<variant>"), F.array().cast("array<variant>"))
    return found.withColumns({**known, "actions": actions}).select(*known, "actions", "report", "file").orderBy(F.desc("evaluated_run_id"), "file")
