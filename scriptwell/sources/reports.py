"""Text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_markdown(lines: DataFrame, path: str) -> None:
    """Write report lines in order as one text file; a report has a few dozen lines."""
    ordered = lines.select("section", "line_no", "line").orderBy("section", "line_no")
    ordered.coalesce(1).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
