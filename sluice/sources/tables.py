"""Sources and sinks: Parquet tables, partitioned layouts, views of a folder, and a scratch place that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

COMPRESSION = "zstd"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table from one file or a folder of files, whose schemas may have grown over time."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Parquet under zstd. With partition columns the rows are dealt by them first, so a value's rows make few files; adaptive
    execution splits a value that is too large."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).option("compression", COMPRESSION).partitionBy(*partition_by).parquet(path)


def register_folder(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Temporary views of the tables in a folder."""
    for name in names:
        read_table(spark, f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def view_statements(folder: str, names: tuple[str, ...]) -> list[str]:
    """The same views as SQL, for another place."""
    return [f"CREATE OR REPLACE TEMPORARY VIEW {n} USING parquet OPTIONS (path '{folder}/{n}.parquet', mergeSchema 'true')" for n in names]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``). Only a local master may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sluice-")
    path = f"{folder.rstrip('/')}/sluice-{what}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def from_footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose counts, minima and maxima come from file footers, read in parallel by the executors."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)
