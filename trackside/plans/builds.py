"""Triage of build runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.constants import FAILED_CONCLUSIONS, FAILURE_KEYWORDS
from trackside.operators.tables import latest, match_or_all


def pick_run(runs: DataFrame, newest: list[str], by: list[str], run_id: int | None = None) -> DataFrame:
    """Per group the run asked for, else the newest one."""
    if run_id is not None:
        runs = match_or_all(runs, F.col("id") == run_id, by).drop("matched")
    return latest(runs, by, newest)


def triage(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """One report row per run: whether it alerts, its failed steps and failure categories.

    ``runs`` has id, name, status, conclusion, head_sha; ``jobs`` has run_id and the nested
    jobs. An alerting run whose steps name no failure counts in every category.
    """
    failed_steps = F.flatten(
        F.transform(
            F.coalesce("jobs", F.array()),
            lambda job: F.transform(
                F.filter(
                    F.coalesce(job["steps"], F.array()), lambda step: F.coalesce(step["conclusion"] == "failure", F.lit(False))
                ),
                lambda step: F.coalesce(step["name"], F.lit("Unknown Step")),
            ),
        )
    )
    alert = F.coalesce(
        (F.col("status") == "completed") & F.col("conclusion").isin(FAILED_CONCLUSIONS), F.lit(False)
    )
    rows = (
        runs.join(jobs.withColumnRenamed("run_id", "id"), "id", "left")
        .withColumn("alert_triggered", alert)
        .withColumn("failed_steps", F.when(alert, failed_steps).otherwise(F.array().cast("array<string>")))
    )
    unnamed = F.size("failed_steps") == 0

    def category(words: list[str]):
        def mentions(step):
            text, hit = F.lower(step), F.lit(False)
            for word in words:
                hit = hit | text.contains(word)
            return hit

        return F.col("alert_triggered") & (unnamed | F.exists("failed_steps", mentions))

    return rows.select(
        F.col("id").alias("evaluated_run_id"),
        F.coalesce("name", F.lit("Unknown Workflow")).alias("workflow_name"),
        "status",
        "conclusion",
        F.coalesce("head_sha", F.lit("Unknown")).alias("commit_sha"),
        "alert_triggered",
        "failed_steps",
        *[category(words).alias(f"{name}_failed") for name, words in FAILURE_KEYWORDS.items()],
    )
