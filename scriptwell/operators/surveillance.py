"""Trailing-window claim counts and threshold alerts over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.fixed_values import (
    ALERT_THRESHOLD,
    ALERT_TYPE,
    ALERT_WINDOW_MINUTES,
    HIGH_SEVERITY_FACTOR,
)


def opioid_only(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("is_opioid", F.lit(False)))


WINDOWS_PER_SLOT = 8


def in_slots(events: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Each event in the slot of its time and, where the next slot's windows reach back to
    it, as past only in that one as well.

    A slot is a few windows long. Slots of one key can be counted apart from each other,
    so a very busy key spreads over many tasks for about an eighth more rows.
    """
    window = minutes * 60 * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))

    def slot_at(moment: Column) -> Column:
        return F.floor(moment / (window * WINDOWS_PER_SLOT))

    own = F.struct(slot_at(us).alias("slot"), F.lit(True).alias("own"))
    past = F.struct(slot_at(us + window).alias("slot"), F.lit(False).alias("own"))
    placed = F.when(slot_at(us + window) > slot_at(us), F.array(own, past)).otherwise(F.array(own))
    return events.withColumn("us", us).select("*", F.inline(placed))


def trailing_count(events: DataFrame, key: str, ts: str,
                   minutes: int = ALERT_WINDOW_MINUTES,
                   name: str = "claim_count_in_window") -> DataFrame:
    """Events of the same key in `[ts - minutes, ts]`, for every event."""
    width = minutes * 60 * 1_000_000
    window = Window.partitionBy(key, "slot").orderBy("us").rangeBetween(-width, 0)
    return (
        in_slots(events, ts, minutes).withColumn(name, F.count(F.lit(1)).over(window))
        .filter("own").drop("us", "slot", "own")
    )


def severity(count: Column, threshold: int) -> Column:
    return F.when(count > threshold * HIGH_SEVERITY_FACTOR, "high").otherwise("medium")


def alerts(counts: DataFrame, threshold: int = ALERT_THRESHOLD,
           minutes: int = ALERT_WINDOW_MINUTES) -> DataFrame:
    """One alert for every event whose count reaches the threshold."""
    n = F.col("claim_count_in_window")
    return counts.filter(n >= threshold).select(
        F.lit(ALERT_TYPE).alias("alert_type"), "prscrbr_npi", "prscrbr_state_abrvtn",
        "claim_count_in_window", F.lit(minutes).alias("window_minutes"),
        F.lit(threshold).alias("threshold"), F.current_timestamp().alias("detected_at"),
        severity(n, threshold).alias("severity"))
