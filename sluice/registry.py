"""The query bank's registry: one builder per operator of the inventory, with the SQL that must give the same rows.

A builder is a function of the session and the folder of the tables. Most are SQL that Spark and an independent engine both
read: tables are written in braces, and ``sql`` binds them to data frames, so nothing is registered in the session. Where the
dialects part, the oracle has its own text; where SQL can't say it, the builder uses the DataFrame API.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, folder, name) for name in set(_TABLE.findall(text))})


def plain(text: str) -> str:
    return _TABLE.sub(r"\1", text)


def case(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query given as SQL; ``oracle``: the other engine's text where it differs."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, folder: sql(spark, folder, text)
    ORACLES[name] = plain(oracle or text)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a builder under its own name, with its oracle when SQL can express it."""

    def register(build: Query) -> Query:
        if build.__name__ in QUERIES:
            raise ValueError(f"{build.__name__} is registered twice")
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = plain(oracle)
        return build

    return register


def cents(column: str) -> str:
    """SQL for an amount in whole cents, so that sums are exact whatever their order."""
    return f"CAST(round({column} * 100) AS BIGINT)"
