"""All registered queries and their SQL twins, except those of optional subpackages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.plans import records, records_sql
from recordloom.plans.general import GENERAL, GENERAL_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.search_rerank(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return records.QUERIES | GENERAL


def oracle_sql() -> dict[str, str]:
    return records_sql.SQL | GENERAL_SQL
