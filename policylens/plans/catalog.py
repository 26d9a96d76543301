"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from policylens.plans import (  # noqa: F401
    eval_queries,
    learn_queries,
    log_queries,
    spec_queries,
    stream_queries,
)
from policylens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["O28_constant_sweep"](spark, folder)
