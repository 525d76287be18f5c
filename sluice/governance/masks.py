"""Masks, set on a table's columns before any statement sees them. A null stays null."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.governance import policy
from sluice.governance.model import Level

REDACTED = "***"


def redact(_: Column) -> Column:
    return F.lit(REDACTED)


def keep_last(column: Column, n: int) -> Column:
    return F.concat(F.lit(REDACTED), F.right(column.cast("string"), F.lit(n)))


def stable_hash(column: Column, pepper: str) -> Column:
    """Twelve hex digits of sha256(value, pepper). hide() keeps the pepper out of the texts of a session's plans."""
    if len(pepper) < 32:
        raise ValueError("the pepper needs 32 characters at least")
    return F.substring(F.sha2(F.encode(F.concat(column.cast("string"), F.lit(pepper)), "utf-8"), 256), 1, 12)


def hide(spark: SparkSession, pepper: str) -> None:
    """Plans of this session, and what is logged of them, show a mark in the pepper's place."""
    spark.conf.set("spark.sql.redaction.string.regex", re.escape(pepper))


def masked(df: DataFrame, table: str, role: str, pepper: str) -> DataFrame:
    """``df`` as the role may see it: masked columns by their masks, denied ones as nulls of their type."""
    out = []
    for f in df.schema.fields:
        name, c = f"{table}.{f.name}", F.col(f.name)
        level = policy.level(role, name)
        if level is Level.DENY:
            c = F.lit(None).cast(f.dataType)
        elif level is Level.MASK:
            rule = policy.COLUMNS[name]
            if rule.mask == "generalise":
                body = F.col(rule.argument)
            else:
                body = {"redact": redact, "keep_last": lambda x: keep_last(x, int(rule.argument)), "hash": lambda x: stable_hash(x, pepper)}[rule.mask](c)
            c = F.when(F.col(f.name).isNotNull(), body)
        out.append(c.alias(f.name))
    return df.select(*out)


def pepper_from_environment(name: str = "SLUICE_PEPPER") -> str:
    return os.environ[name]
