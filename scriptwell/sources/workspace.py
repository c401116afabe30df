"""Intermediate tables in the shared folder.

A derived table that several branches of a plan or several queries read is written once
as Parquet where every executor can reach it, and read back with pruning and pushdown.
Losing an executor then costs a re-read, not a re-run of the lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptwell.session import shared_folder


def application_folder(spark: SparkSession) -> str:
    """Everything one application stores lies under this folder."""
    root = shared_folder(spark).rstrip("/")
    return f"{root}/scriptwell/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Store a DataFrame under a fresh name in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_state(spark: SparkSession, source: str) -> tuple:
    """Name, size and time of what lies in a folder; empty for a source that is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return ()
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime())
                        for f in files.listStatus(folder)))


class StoredTables:
    """Tables of one application, each built on first use and anew when its source has changed."""

    _tables: dict[tuple, tuple[tuple, DataFrame]] = {}

    @classmethod
    def get(cls, spark: SparkSession, source: str, name: str,
            build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        source = source.rstrip("/")
        key = (spark.sparkContext.applicationId, id(spark), source, name)
        state = source_state(spark, source)
        if key not in cls._tables or cls._tables[key][0] != state:
            cls._tables[key] = state, write_once(build(), name, partition_by)
        return cls._tables[key][1]

    @classmethod
    def discard(cls, spark: SparkSession) -> None:
        """Delete what this application stored, once nothing reads it any more."""
        app = spark.sparkContext.applicationId
        cls._tables = {k: v for k, v in cls._tables.items() if k[0] != app}
        folder = spark._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(folder, True)
