"""Trailing-window counts per prescriber over a stream, kept in the state store."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from scriptwell.fixed_values import ALERT_WINDOW_MINUTES
from scriptwell.operators.surveillance import in_slots, opioid_only

# Tasks carry this module's code with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
COUNT_SCHEMA = StructType([
    StructField("claim_id", StringType()),
    StructField("prscrbr_npi", LongType()),
    StructField("prscrbr_state_abrvtn", StringType()),
    StructField("event_time", TimestampType()),
    StructField("claim_count_in_window", LongType()),
])
_BUCKET = StructType([StructField("bucket", LongType())])
# Equally long arrays of 64-bit integers: prescriber, time in microseconds, events then.
_TIMES = StructType([StructField(name, BinaryType()) for name in ("npi", "us", "n")])
# Groups of prescribers that share their state.
SHARDS = 512
# Stands for a missing prescriber inside tasks, where numbers have no nulls.
_NO_NPI = -2**63
# Counted events leave a group as equally long arrays, so many in a row at most.
_FIELDS = ["us" if f.name == "event_time" else f.name for f in COUNT_SCHEMA]
_COUNTED, _COUNTED_TOGETHER = Row(*_FIELDS), 10_000
_COUNTED_SCHEMA = StructType([
    StructField(name, ArrayType(LongType() if name == "us" else f.dataType))
    for name, f in zip(_FIELDS, COUNT_SCHEMA, strict=True)])

Times = tuple[np.ndarray, np.ndarray, np.ndarray]


def _merged(parts: list[Times]) -> Times:
    """Prescribers, times and events then, ordered by the first two, each pair of which comes once."""
    npi, us, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((us, npi))
    npi, us, n = npi[order], us[order], n[order]
    new = np.flatnonzero((np.diff(npi) != 0) | (np.diff(us) != 0)) + 1
    starts = np.concatenate(([0], new)) if len(n) else new
    return npi[starts], us[starts], np.add.reduceat(n, starts) if len(n) else n


def _events_between(known: Times, npi: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Known events of each given prescriber from a first to a last time, both included. The known
    ones are ordered by prescriber and time; prescribers and times are compared by their places."""
    who, when = np.unique(known[0]), np.unique(known[1])
    step = len(when) + 1
    placed = np.searchsorted(who, known[0]) * step + np.searchsorted(when, known[1])
    upto = np.concatenate(([0], np.cumsum(known[2])))
    base = np.searchsorted(who, npi) * step
    return (upto[np.searchsorted(placed, base + np.searchsorted(when, last, "right"))]
            - upto[np.searchsorted(placed, base + np.searchsorted(when, first))])


class TrailingCounter(StatefulProcessor):
    """Counts each prescriber's events in a window that ends at each of them, for the prescribers
    of one shard and one slot.

    Event times lie in a map of buckets as long as the window, each time with its multiplicity.
    A batch reads the buckets that its windows reach into and writes those that its events fall
    into; a timer removes a bucket once no window of an accepted event reaches it any more. Each
    such step is a message to the state store, whoever's events it is for.
    """

    def __init__(self, window_minutes: int):
        self._window_us = window_minutes * 60 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getMapState("seen", _BUCKET, _TIMES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = json.loads(f"[{','.join(r['event'] for r in rows)}]")
        npi = np.array([e.get("prscrbr_npi", _NO_NPI) for e in fresh], dtype=np.int64)
        us = np.array([e["us"] for e in fresh], dtype=np.int64)
        buckets = us // self._window_us
        touched = np.unique(buckets).tolist()
        known = []
        for bucket in sorted({b - back for b in touched for back in (0, 1)}):
            # A bucket's event times; None where nothing is stored.
            stored = self._seen.getValue((bucket,))
            times = [tuple(np.frombuffer(x, dtype="<i8") for x in stored)] if stored else []
            if bucket in touched:
                if not times:
                    self._handle.registerTimer((bucket + 2) * self._window_us // 1000)
                own = buckets == bucket
                times = [_merged([*times, (npi[own], us[own], np.ones(own.sum(), np.int64))])]
                self._seen.updateValue((bucket,), tuple(x.astype("<i8").tobytes() for x in times[0]))
            known += times
        at = np.flatnonzero([e["own"] for e in fresh])
        counts = _events_between(_merged(known), npi[at], us[at] - self._window_us, us[at]).tolist()
        for first in range(0, len(at), _COUNTED_TOGETHER):
            some = slice(first, first + _COUNTED_TOGETHER)
            own = [fresh[i] for i in at[some]]
            yield _COUNTED(*([e.get(name) for e in own] for name in _FIELDS[:-1]), counts[some])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._seen.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // self._window_us - 2,))
        yield from ()

    def close(self) -> None:
        pass


def trailing_counts(events: DataFrame, minutes: int = ALERT_WINDOW_MINUTES,
                    shards: int = SHARDS) -> DataFrame:
    """Per opioid event its trailing count; the input must carry a watermark.

    State is kept per shard of prescribers and slot of time, whatever key the messages were
    published under. One group holds a few windows of a shard's events and no more; more shards
    make groups smaller, and a checkpoint keeps to the number it was begun with.
    """
    shard = F.pmod(F.xxhash64("prscrbr_npi"), F.lit(shards))
    counted = (
        in_slots(opioid_only(events), "event_time", minutes)
        # Each column of each row costs a conversion in Python, so most of them go as one text. The
        # event time is there for the engine, which drops late rows.
        .select("event_time", (F.col("slot") * shards + shard).alias("group"), F.to_json(F.struct(
            "claim_id", "prscrbr_npi", "prscrbr_state_abrvtn", "us", "own")).alias("event"))
        .groupBy("group")
        .transformWithState(
            statefulProcessor=TrailingCounter(minutes), outputStructType=_COUNTED_SCHEMA,
            outputMode="Append", timeMode="EventTime")
    )
    return counted.select(F.inline(F.arrays_zip(*_FIELDS))).select(
        "claim_id", "prscrbr_npi", "prscrbr_state_abrvtn",
        F.timestamp_micros("us").alias("event_time"), "claim_count_in_window")
