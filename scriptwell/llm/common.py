"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id where ids are compared: after every other.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, text. Both together name a document: rows that share an id but not
    the text stay apart, rows equal in both have equal results."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return (left["doc_id"].eqNullSafe(right["doc_id"])
            & (left["text_hash"] == right["text_hash"]))


def with_ranges(docs: DataFrame, ranges: DataFrame, how: str = "left") -> DataFrame:
    """Documents as identified() gives them, with column ranges joined by document."""
    right = ranges.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "ranges")
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_id"))
                     & (F.col("text_hash") == F.col("_hash")), how).drop("_id", "_hash")


def by_size(sizes: list[int], most: int) -> Iterator[range]:
    """Ranges of neighbouring texts that hold about that many characters, one text at least."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield range(first, i)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield range(first, len(sizes))


def unused(columns: list[str], *names: str) -> list[str]:
    """Helper column names that differ, whatever the case, from all columns of an input."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found
