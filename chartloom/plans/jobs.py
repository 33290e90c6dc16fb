"""Queries of the job operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.operators import jobs
from chartloom.session import table

LAST = """last AS (SELECT * FROM ingest_jobs WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, attempts DESC NULLS LAST, status DESC NULLS LAST) = 1)"""


def j01_latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of each job."""
    return jobs.latest_jobs(table(spark, sf_dir, "ingest_jobs")).select("job_id", "document_id", "status", "attempts", "max_attempts", "updated_at")


def j05_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by state."""
    return jobs.state_counts(table(spark, sf_dir, "ingest_jobs"))


def j06_job_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states each job went through."""
    return jobs.job_histories(table(spark, sf_dir, "ingest_jobs"))


QUERIES = {f.__name__: f for f in (j01_latest_jobs, j05_state_counts, j06_job_histories)}
SQL = {
    "j01_latest_jobs": f"WITH {LAST} SELECT job_id, document_id, status, attempts, max_attempts, updated_at FROM last",
    "j05_state_counts": f"WITH {LAST} SELECT status, count(*) AS jobs, round(avg(attempts), 6) AS mean_attempts, round(avg(updated_at - created_at), 3) AS seconds FROM last GROUP BY 1",
    "j06_job_histories": """WITH s AS (SELECT DISTINCT job_id, updated_at, attempts, status FROM ingest_jobs WHERE job_id IS NOT NULL)
SELECT job_id, count(*) AS events, string_agg(coalesce(status, '?'), '>' ORDER BY updated_at, attempts, status) AS history FROM s GROUP BY 1""",
}
