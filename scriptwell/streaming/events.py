"""Claim streams: reading, decoding, routing, deduplication, landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptwell.functions.contract import check_events


def read_claims(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of one topic from its latest offsets on; progress is kept by checkpoints."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "latest").load()
    )
    return raw.select(F.col("value").cast("string").alias("value"))


def read_claim_files(spark: SparkSession, path: str, schema: StructType | str = "value string",
                     files_per_trigger: int = 16, file_format: str = "parquet") -> DataFrame:
    """The same stream from files appearing under a path."""
    return (
        spark.readStream.format(file_format).schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def decoded(messages: DataFrame) -> DataFrame:
    """Raw text, typed fields, event time and contract errors."""
    return check_events(messages.select("value"))


def side(errors: str = "errors") -> Column:
    """"valid" without errors, else "invalid"."""
    return F.when(F.size(errors) == 0, "valid").otherwise("invalid")


def route(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows."""
    return (checked.filter(side() == "valid").drop("errors"),
            checked.filter(side() == "invalid").select("value", "errors"))


def with_watermark(df: DataFrame, ts: str = "event_time", delay: str = "60 minutes") -> DataFrame:
    return df.withWatermark(ts, delay)


def dedup_stream(df: DataFrame, key: str = "claim_id") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay of the first one."""
    return df.dropDuplicatesWithinWatermark([key])


def key_by(df: DataFrame, column: str = "prscrbr_state_abrvtn") -> DataFrame:
    """Bring rows of one key value together."""
    return df.repartition(column)


def landing_rows(valid: DataFrame) -> DataFrame:
    """Valid events with the arrival hour they are filed under."""
    return valid.withColumn("date_hour", F.date_format(F.current_timestamp(), "yyyy-MM-dd-HH"))
