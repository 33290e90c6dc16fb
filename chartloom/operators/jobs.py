"""Ingest jobs from their change events: latest state, durations, counts per state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_jobs(events: DataFrame) -> DataFrame:
    """The last event of each job: by time of update, then attempts, then status. Events without job are left out."""
    own = events.where("job_id is not null")
    rest = [c for c in events.columns if c != "job_id"]
    order = F.struct("updated_at", "attempts", "status")
    return own.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("e")).select("job_id", "e.*")


def state_counts(events: DataFrame) -> DataFrame:
    """(status, jobs, mean_attempts, seconds): jobs by their last state, mean attempts, mean seconds from creation."""
    return latest_jobs(events).groupBy("status").agg(
        F.count("*").alias("jobs"), F.round(F.avg("attempts"), 6).alias("mean_attempts"), F.round(F.avg(F.col("updated_at") - F.col("created_at")), 3).alias("seconds")
    )


def job_histories(events: DataFrame) -> DataFrame:
    """(job_id, events, history): distinct states of each job in order of update, joined by arrows."""
    steps = events.where("job_id is not null").select("job_id", "updated_at", "attempts", "status").distinct()
    listed = steps.groupBy("job_id").agg(F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct("updated_at", "attempts", "status"))).alias("s"))
    return listed.select("job_id", "events", F.array_join(F.transform("s", lambda x: F.coalesce(x["status"], F.lit("?"))), ">").alias("history"))
