"""Relational source scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptwell.fixed_values import JDBC_FETCH_SIZE


def _properties(props: dict | None) -> dict:
    return {"fetchsize": str(JDBC_FETCH_SIZE), **(props or {})}


def read_jdbc(spark: SparkSession, url: str, table: str, props: dict | None = None) -> DataFrame:
    return spark.read.jdbc(url, table, properties=_properties(props))


def split_bounds(spark: SparkSession, url: str, table: str, column: str,
                 props: dict | None = None) -> tuple[int, int] | None:
    """Smallest and largest split value, computed by the database; None when empty."""
    query = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) bounds"
    row = spark.read.jdbc(url, query, properties=_properties(props)).first()
    return None if row is None or row[0] is None else (int(row[0]), int(row[1]))


def read_jdbc_partitioned(spark: SparkSession, url: str, table: str, column: str,
                          lower: int | None = None, upper: int | None = None,
                          n: int = 200, props: dict | None = None) -> DataFrame:
    """Parallel range scan; without bounds they come from the data.

    Bounds set only the stride: rows outside them and null keys are still read.
    """
    if lower is None or upper is None:
        bounds = split_bounds(spark, url, table, column, props)
        if bounds is None:
            return read_jdbc(spark, url, table, props)
        lower, upper = bounds
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper + 1, numPartitions=n,
        properties=_properties(props))
