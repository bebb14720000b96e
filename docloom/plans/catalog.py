"""All queries of the engine, gathered from the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import ingestion, relational, search, texts  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)
