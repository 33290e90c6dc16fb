"""Queries of the timestamp operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.operators.timestamps import contradicting_records, dated_records, normalise
from chartloom.session import table


def _inputs(spark: SparkSession, sf_dir: str):
    encounters, facilities, chunks, medications = (table(spark, sf_dir, t) for t in ("encounters", "facilities", "chunks", "medications"))
    return encounters, facilities, {"chunks": (chunks, "chunk_id"), "medications": (medications, "id")}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose date contradicts their encounter's."""
    encounters, facilities, tables = _inputs(spark, sf_dir)
    return contradicting_records(encounters, facilities, **tables)


def p3_normalised_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of encounters, chunks and medications as UTC moments or local days."""
    encounters, facilities, tables = _inputs(spark, sf_dir)
    return normalise(dated_records(encounters, facilities, **tables)).select(
        "source_table", "record_key", "encounter_id", "utc", "local_day", "precision", "format", "posterior", "clock", "status"
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_normalised_dates)}
SQL: dict[str, str] = {}
