"""Catalog tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def match_by_name(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of a target schema, matched by case-insensitive name and cast.

    A target column the source lacks stops the load, as does a value that does not fit.
    """
    available = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema if f.name.lower() not in available]
    if missing:
        raise ValueError(f"source lacks columns {missing}")
    return df.select(*[
        F.col(available[f.name.lower()]).cast(f.dataType).alias(f.name) for f in schema
    ])


def create_table(spark: SparkSession, name: str, schema: StructType) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING PARQUET")


def load_by_name(df: DataFrame, target: str) -> None:
    """Append to a catalog table by column name; the single write commits whole or not at all."""
    schema = df.sparkSession.table(target).schema
    match_by_name(df, schema).write.insertInto(target)


def materialize(df: DataFrame, name: str, kind: str = "view",
                cluster_by: str | None = None) -> DataFrame:
    """A model as temp view, as inlined plan, or as a table clustered by one column."""
    if kind == "ephemeral":
        return df
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        # Range partitioning keeps each value's rows in few files, so scans skip by min/max;
        # the hash spreads a value that holds much of the table over several tasks.
        laid_out = df if cluster_by is None else (
            df.repartitionByRange(cluster_by, F.xxhash64(*df.columns))
            .sortWithinPartitions(cluster_by))
        laid_out.write.mode("overwrite").format("parquet").saveAsTable(name)
    else:
        raise ValueError(f"unknown model kind {kind}")
    return df.sparkSession.table(name)
