"""The query bank: importing it registers the queries of all operator modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.operators import aggregates, functions, governed, joins, queries, relational, views, windows  # noqa: F401
from sluice.registry import ORACLES, QUERIES, case, cents, plain, query, sql, table  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["governed_aggregate"](spark, folder)
