"""Stream sinks: keyed messages, hourly landing, batch-keyed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptwell.streaming.events import landing_rows, route, side

# Producer settings: acknowledged by all replicas, no duplicates on retry.
PRODUCER_OPTIONS = {
    "kafka.acks": "all", "kafka.retries": "5", "kafka.retry.backoff.ms": "200",
    "kafka.enable.idempotence": "true", "kafka.compression.type": "snappy",
}


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Alerts as messages keyed by prescriber."""
    return alerts.select(F.col("prscrbr_npi").cast("string").alias("key"),
                         F.to_json(F.struct("*")).alias("value"))


def claim_messages(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, refused): valid claims stamped and keyed by state, and the rest."""
    valid, refused = route(checked)
    fields = [c for c in valid.columns if c not in ("value", "event_time")]
    stamped = valid.select(*fields).withColumn(
        "_produced_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return stamped.select(F.col("prscrbr_state_abrvtn").alias("key"),
                          F.to_json(F.struct("*")).alias("value")), refused


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """Write a batch of messages to a topic."""
    (messages.write.format("kafka").options(**PRODUCER_OPTIONS)
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def publish_stream(messages: DataFrame, servers: str, topic: str,
                   checkpoint: str) -> StreamingQuery:
    return (messages.writeStream.format("kafka").options(**PRODUCER_OPTIONS)
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())


def land(valid: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """File valid events by arrival hour."""
    writer = (landing_rows(valid).writeStream.format("parquet").partitionBy("date_hour")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sink(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write each micro-batch to its own directory; a replayed batch overwrites itself."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    writer = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def routed_sink(checked: DataFrame, path: str, checkpoint: str,
                available_now: bool = False) -> StreamingQuery:
    """Valid and invalid rows of each micro-batch in one pass, apart by the `side` partition."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = landing_rows(batch).withColumn("side", side())
        rows.write.mode("overwrite").partitionBy("side", "date_hour").parquet(
            f"{path.rstrip('/')}/batch_id={batch_id}")

    writer = checked.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_sink(df: DataFrame, path: str, checkpoint: str, ts: str = "event_time",
              delay_minutes: int = 60, available_now: bool = False) -> StreamingQuery:
    """Each micro-batch apart by the `late` partition, so that no row is lost uncounted.

    A row is late if its time is not after the newest time of all earlier batches less the delay. A
    stateful operator with that watermark drops such rows, but may apply a new watermark one
    batch later. The newest time is taken from
    the write of each batch and kept beside it under the batch's number, so a replayed batch is
    divided as before. Rows without a time are not late.
    """
    path, marks = path.rstrip("/"), f"{path.rstrip('/')}-marks"

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, us = batch.sparkSession, F.unix_micros(F.col(ts).cast("timestamp"))
        newest = None
        if batch_id:
            newest = spark.read.schema("newest long").parquet(
                f"{marks}/batch_id={batch_id - 1}").first()["newest"]
        # The engine keeps its watermark in milliseconds.
        behind = F.lit(None) if newest is None else \
            us <= (newest // 1000 - delay_minutes * 60_000) * 1000
        seen = Observation()
        (batch.withColumn("late", F.coalesce(behind, F.lit(False)))
         .observe(seen, F.max(us).alias("newest"))
         .write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch_id={batch_id}"))
        newest = max((x for x in (newest, seen.get["newest"]) if x is not None), default=None)
        spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode(
            "overwrite").parquet(f"{marks}/batch_id={batch_id}")

    writer = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
