"""System metrics and job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def system_metrics(incidents: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """K1: totals and the latest incident in one row."""
    order = F.struct("created_at", -F.col("id"))
    latest = F.max_by(F.struct("id", "title", "created_at"), order)

    def total(df):
        return df.select(F.count(F.lit(1))).scalar()

    return incidents.agg(
        F.count(F.lit(1)).alias("incidents_total"), latest.alias("last_incident")
    ).select(
        "incidents_total",
        total(sources).alias("sources_total"),
        total(tags).alias("tags_total"),
        F.col("last_incident.id").alias("last_incident_id"),
        F.col("last_incident.title").alias("last_incident_title"),
        F.date_format("last_incident.created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_incident_created_at"),
    )


def due_jobs(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs to run; a job still marked running is never due."""
    idle = F.col("status").isNull() | (F.col("status") != "running")
    due = F.col("next_run").isNull() | (F.col("next_run") == "") | (F.col("next_run") <= now)
    return jobs.filter(idle & due)


def job_history(executions: DataFrame, job_id: str | None = None, limit: int | None = 10) -> DataFrame:
    """Newest executions first, optionally of one job; ``None`` means all."""
    rows = executions.filter(F.col("job_id") == job_id) if job_id else executions
    ordered = rows.orderBy(F.desc("end_time"), F.desc("id"))
    return ordered if limit is None else ordered.limit(limit)
