"""All registered queries of the core with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartloom.plans import chunks, dates, jobs, pages, retrieval, structure

MODULES = (dates, pages, structure, chunks, retrieval, jobs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query behind ``entry``."""
    return queries()["g17_results"](spark, sf_dir)
