"""Access audit, retention and telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scriptwell.fixed_values import AUDIT_RETENTION_YEARS, AUDITED_PATH_PREFIXES
from scriptwell.functions.columns import starts_with_any
from scriptwell.operators.ranking import quantiles
from scriptwell.schemas import ACCESS_LOG


def audit_extract(accesses: DataFrame) -> DataFrame:
    """Accesses to audited paths; the user may be unknown."""
    return accesses.filter(starts_with_any("path", AUDITED_PATH_PREFIXES)).select(
        "log_id", "username", "path", "method", "status_code",
        F.round("duration_ms", 2).alias("duration_ms"),
        F.coalesce("client_ip", F.lit("unknown")).alias("client_ip"), "accessed_at")


def get_phi_audit_logs(log: DataFrame, limit: int = 50) -> DataFrame:
    if not 10 <= limit <= 200:
        raise ValueError("limit must lie between 10 and 200")
    return log.orderBy(F.desc("accessed_at"), "log_id").limit(limit)


def append_access(spark: SparkSession, path: str, records: list[dict]) -> None:
    """Append access records, timed by the cluster and given an id."""
    given = [f for f in ACCESS_LOG if f.name not in ("log_id", "accessed_at")]
    append_accesses(spark.createDataFrame(
        [Row(**{f.name: r.get(f.name) for f in given}) for r in records],
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given)), path)


def append_accesses(rows: DataFrame, path: str) -> None:
    """Append a table of accesses, such as a micro-batch, in one write: ids and times are given by
    the cluster, fields the rows lack are null."""
    given = [f for f in ACCESS_LOG if f.name not in ("log_id", "accessed_at")]
    stamped = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in given]).withColumns({
        "log_id": F.expr("uuid()"),
        "accessed_at": F.current_timestamp().cast("timestamp_ntz"),
    })
    stamped.select(*ACCESS_LOG.fieldNames()).write.mode("append").parquet(path)


def archivable(log: DataFrame, archive: DataFrame, now: Column,
               years: int = AUDIT_RETENTION_YEARS) -> DataFrame:
    """Rows past retention that the archive lacks; the log itself keeps them."""
    cutoff = now.cast("timestamp_ntz") - F.expr(f"INTERVAL '{years}' YEAR")
    old = log.filter(F.col("accessed_at") < cutoff)
    return old.join(archive.select("log_id"), "log_id", "left_anti")


def archive_old(log: DataFrame, archive_path: str, now: Column,
                years: int = AUDIT_RETENTION_YEARS) -> None:
    """Append to the archive what `archivable` finds; running twice adds nothing. An archive that
    isn't there yet is empty."""
    spark = log.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(archive_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    archive = spark.read.schema(ACCESS_LOG).parquet(archive_path) if there \
        else spark.createDataFrame([], ACCESS_LOG)
    archivable(log, archive, now, years).select(*ACCESS_LOG.fieldNames()).write.mode(
        "append").parquet(archive_path)


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def query_volume(query_log: DataFrame) -> DataFrame:
    return query_log.groupBy("status").agg(F.count(F.lit(1)).alias("queries"))


def access_rollup(log: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Requests, server errors and request rate per path and time window."""
    slot = F.window(F.col("accessed_at"), window)
    return log.groupBy(slot.alias("slot"), "path").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status_code") >= 500).alias("server_errors"),
    ).select(
        F.col("slot.start").alias("window_start"), "path", "requests", "server_errors",
        (F.col("requests") / (F.unix_seconds(F.col("slot.end").cast("timestamp"))
                              - F.unix_seconds(F.col("slot.start").cast("timestamp"))))
        .alias("requests_per_second"))


def latency_quantiles(log: DataFrame) -> DataFrame:
    """p50, p95 and p99 per path."""
    return quantiles(log, ["path"], "duration_ms", {"p50": "0.5", "p95": "0.95", "p99": "0.99"})
