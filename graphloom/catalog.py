"""Registry of the engine's queries and of their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import ORACLE_SQL, QUERIES
from .queries.graph import FLAGSHIP

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)
