"""Parameterised and guarded ad-hoc SQL over temp views."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from scriptwell.fixed_values import DEFAULT_ROW_CAP, FORBIDDEN_SQL_WORDS
from scriptwell.schemas import QUERY_LOG

_SELECT = re.compile(r"SELECT\b", re.IGNORECASE)
_FORBIDDEN = re.compile(r"\b(?:%s)\b" % "|".join(FORBIDDEN_SQL_WORDS), re.IGNORECASE)
#: Literals, quoted names and comments, whose words say nothing about the statement.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)
_CAPPED_OR_AGGREGATE = re.compile(
    r"\bLIMIT\s*(?:\b(?:ALL|CAST)\b|[\d:?({])|\b(?:COUNT|SUM|AVG)\s*\(", re.IGNORECASE)


class UnsafeSQLError(ValueError):
    """The statement is not a single plain SELECT."""


def validate_sql(sql: str, cap: int = DEFAULT_ROW_CAP) -> str:
    """The statement, capped when it neither limits nor aggregates; raises when unsafe.

    Words in literals, quoted names and comments don't count as a limit or an aggregate, nor does a
    column named limit. The cap goes to a line of its own if the last one may end in a comment.
    """
    statement = sql.strip().rstrip(";")
    if not _SELECT.match(statement.lstrip()):
        raise UnsafeSQLError("only SELECT statements may run")
    word = _FORBIDDEN.search(statement)
    if word:
        raise UnsafeSQLError(f"statement contains {word.group(0).upper()}")
    if ";" in statement:
        raise UnsafeSQLError("only one statement may run")
    # A mark stays in place of each, so that the words around it don't join.
    bare = _QUOTED.sub(" _ ", statement)
    if _CAPPED_OR_AGGREGATE.search(bare):
        return statement
    apart = "\n" if "--" in statement.rpartition("\n")[2] else " "
    return f"{statement}{apart}LIMIT {cap}"


def run_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    return spark.sql(sql, args=params or {})


def run_guarded(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    return run_query(spark, validate_sql(sql), params)


def run_logged(spark: SparkSession, path: str, username: str, question: str, sql: str,
               params: dict | None = None) -> DataFrame | None:
    """Run a guarded statement and append how it went to the log: success with its rows, rejected
    by the guard, or failed in the engine. The result, or None if there is none."""
    result, rows, status = None, 0, "success"
    try:
        result = run_guarded(spark, sql, params)
        seen = Observation()
        # All columns are computed, so that what fails in them is told.
        result.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode(
            "overwrite").save()
        rows = seen.get["rows"]
    except UnsafeSQLError:
        status = "rejected"
    except PySparkException:
        result, status = None, "failed"
    log_query(spark, path, username, question, sql, rows, status)
    return result


def query_log_row(spark: SparkSession, username: str, question: str, sql: str,
                  row_count: int, status: str) -> DataFrame:
    """One log entry, ready to append; status is success, rejected or failed."""
    entry = spark.createDataFrame(
        [Row(query_id=str(uuid.uuid4()), username=username, question=question,
             generated_sql=sql, row_count=row_count, status=status)],
        "query_id string, username string, question string, generated_sql string, "
        "row_count long, status string")
    return entry.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).select(
        *QUERY_LOG.fieldNames())


def log_query(spark: SparkSession, path: str, username: str, question: str, sql: str,
              row_count: int, status: str) -> None:
    query_log_row(spark, username, question, sql, row_count, status).write.mode("append").parquet(
        path)
