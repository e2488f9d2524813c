"""Queries over the job log: one row per validation job.

Columns: job_id, filename, action, status (pending / running / completed / failed),
created_at, updated_at, total_records, valid_records, invalid_records and
success_rate (percent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT_JOBS = 5


def _completed(value: str) -> Column:
    return F.when(F.col("status") == "completed", F.coalesce(value, F.lit(0)))


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))


def job_statistics(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, record totals and success rate of completed jobs."""
    status = F.col("status")
    counts = jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *[F.count_if(status == s).alias(f"{s}_jobs") for s in ("completed", "failed", "running")],
        *[
            _total(_completed(f"{k}_records")).alias(f"{k}_records")
            for k in ("total", "valid", "invalid")
        ],
    )
    rate = F.col("valid_records") / F.col("total_records") * 100
    return counts.withColumn(
        "success_rate", F.when(F.col("total_records") > 0, rate).otherwise(0.0)
    )


def quarantined_jobs(jobs: DataFrame) -> DataFrame:
    """Completed jobs with invalid records, their severity and risk."""
    invalid, total = F.col("invalid_records"), F.col("total_records")
    # the rate is known to two decimals, and whole percents count
    percent = F.floor(F.round("success_rate", 2))
    return jobs.where((F.col("status") == "completed") & (invalid > 0)).select(
        F.col("job_id").alias("id"),
        "filename",
        F.format_string("Validation failed: %d invalid records", invalid).alias("reason"),
        F.when(invalid > total * 0.1, "high").otherwise("medium").alias("severity"),
        invalid.alias("records"),
        total.alias("total_records"),
        F.col("updated_at").alias("quarantine_date"),
        F.greatest(F.lit(0).cast("bigint"), 100 - percent).alias("risk_score"),
    )


def results_overview(jobs: DataFrame) -> DataFrame:
    """One row: jobs by state (pending counts as running), mean score, total issues."""
    status = F.col("status")
    rate = F.round("success_rate", 2)
    mean = F.round(
        F.sum(F.when(status == "completed", F.coalesce(rate, F.lit(0.0))))
        / F.nullif(F.count_if(status == "completed"), F.lit(0))
    )
    return jobs.agg(
        F.count_if(status == "completed").alias("completed_jobs"),
        F.count_if(status == "failed").alias("failed_jobs"),
        F.count_if(status.isin("running", "pending")).alias("running_jobs"),
        F.coalesce(mean, F.lit(0.0)).cast("bigint").alias("average_quality_score"),
        _total(F.coalesce("invalid_records", F.lit(0))).alias("total_issues"),
    )


def with_risk_bucket(quarantined: DataFrame) -> DataFrame:
    """HIGH, MEDIUM or LOW for each quarantined job."""
    risk = F.col("risk_score")
    return quarantined.withColumn(
        "risk_bucket", F.when(risk >= 80, "HIGH").when(risk >= 50, "MEDIUM").otherwise("LOW")
    )


def high_risk(quarantined: DataFrame) -> DataFrame:
    return quarantined.where(F.col("risk_score") >= 80)


def risk_overview(quarantined: DataFrame) -> DataFrame:
    """One row: items, items per bucket, quarantined records."""
    bucket = with_risk_bucket(quarantined)
    return bucket.agg(
        F.count(F.lit(1)).alias("items"),
        *[
            F.count_if(F.col("risk_bucket") == b).alias(f"{b.lower()}_risk_items")
            for b in ("HIGH", "MEDIUM", "LOW")
        ],
        _total(F.col("records")).alias("quarantined_records"),
    )


def newest_jobs(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs, newest first; the ``limit`` newest of them if given."""
    ordered = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    return ordered if limit is None else ordered.limit(limit)
