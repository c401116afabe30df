import datetime as dt
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptwell.operators import cleaning, surveillance
from scriptwell.plans import queries, testdata
from scriptwell.streaming import events as ev
from scriptwell.streaming import sinks, tracker

T0 = dt.datetime(2024, 1, 1, 12)


def message(i, npi, at, opioid=True, state="TX"):
    return json.dumps({
        "claim_id": f"c{i}", "prscrbr_npi": 1_000_000_000 + npi, "prscrbr_state_abrvtn": state,
        "gnrc_name": "G", "brnd_name": "B", "is_opioid": opioid, "drug_cost_usd": 1.5,
        "claim_timestamp": at.strftime("%Y-%m-%dT%H:%M:%SZ")})


def put(spark, folder, texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode(
        "append").parquet(f"{folder}/in")


def stream(spark, folder):
    valid, _ = ev.route(ev.decoded(ev.read_claim_files(spark, f"{folder}/in", files_per_trigger=1)))
    return valid


def count_now(spark, folder, minutes=60):
    counts = tracker.trailing_counts(ev.with_watermark(stream(spark, folder)), minutes)
    sinks.sink(counts, f"{folder}/out", f"{folder}/check", available_now=True).awaitTermination()
    rows = spark.read.schema(tracker.COUNT_SCHEMA).parquet(f"{folder}/out").collect()
    return {r.claim_id: r.claim_count_in_window for r in rows}


def test_stream_equals_batch_across_a_restart(spark, folder):
    random.seed(5)
    seconds = sorted(random.randint(0, 20 * 3600) for _ in range(400))
    rows = [(i, random.choice([1, 1, 2, 3]), T0 + dt.timedelta(seconds=s))
            for i, s in enumerate(seconds)]
    texts = [message(*r) for r in rows]
    put(spark, folder, texts[:150])
    count_now(spark, folder)
    put(spark, folder, texts[150:300])
    put(spark, folder, texts[300:])
    streamed = count_now(spark, folder)
    batch = surveillance.trailing_count(
        spark.createDataFrame([(f"c{i}", n, t) for i, n, t in rows],
                              "claim_id string, npi long, ts timestamp"), "npi", "ts", 60, "n")
    assert streamed == {r.claim_id: r.n for r in batch.collect()}


def test_late_events(spark, folder):
    hour = dt.timedelta(hours=1)
    put(spark, folder, [message(0, 1, T0), message(1, 1, T0 + 3 * hour)])
    count_now(spark, folder)
    # The watermark stands at T0 + 2 h: one event within the delay, one behind it.
    put(spark, folder, [message(2, 1, T0 + 2.5 * hour), message(3, 1, T0 + hour)])
    counts = count_now(spark, folder)
    assert counts == {"c0": 1, "c1": 1, "c2": 1}
    put(spark, folder, [message(4, 1, T0 + 3 * hour)])
    assert count_now(spark, folder)["c4"] == 3


def test_only_valid_opioid_events_are_counted(spark, folder):
    put(spark, folder, [message(0, 1, T0), message(1, 1, T0, opioid=False),
                        message(2, 1, T0, state="ZZ"), "{bad", message(3, 1, T0)])
    assert count_now(spark, folder) == {"c0": 2, "c3": 2}


def test_routed_sink_and_landing(spark, folder):
    put(spark, folder, [message(0, 1, T0), "{bad", message(1, 1, T0, state="ZZ")])
    checked = ev.decoded(ev.read_claim_files(spark, f"{folder}/in"))
    sinks.routed_sink(checked, f"{folder}/routed", f"{folder}/c1",
                      available_now=True).awaitTermination()
    routed = spark.read.parquet(f"{folder}/routed")
    assert [r.claim_id for r in routed.filter("side = 'valid'").collect()] == ["c0"]
    assert routed.filter("side = 'invalid' AND size(errors) > 0").count() == 2

    sinks.land(stream(spark, folder), f"{folder}/landed", f"{folder}/c2",
               available_now=True).awaitTermination()
    landed = spark.read.parquet(f"{folder}/landed")
    assert landed.count() == 1
    assert landed.filter(F.col("date_hour").rlike(r"^\d{4}-\d{2}-\d{2}-\d{2}$")).count() == 1


def test_replayed_claims_are_dropped(spark, folder):
    put(spark, folder, [message(0, 1, T0), message(0, 1, T0), message(1, 1, T0)])
    put(spark, folder, [message(1, 1, T0)])
    unique = ev.dedup_stream(ev.with_watermark(stream(spark, folder)))
    sinks.sink(unique, f"{folder}/out", f"{folder}/check", available_now=True).awaitTermination()
    assert sorted(r.claim_id for r in spark.read.parquet(f"{folder}/out").collect()) == ["c0", "c1"]


def test_messages(spark):
    checked = ev.decoded(spark.createDataFrame(
        [(message(0, 1, T0),), (message(1, 1, T0, state="ZZ"),)], "value string"))
    messages, refused = sinks.claim_messages(checked)
    row = messages.first()
    body = json.loads(row.value)
    assert row.key == "TX" and body["claim_id"] == "c0" and "_produced_at" in body
    assert refused.count() == 1
    again = ev.decoded(messages.select("value"))
    assert again.first().errors == []

    alerts = spark.createDataFrame([(15, 1234567890, "TX")],
                                   "claim_count_in_window long, prscrbr_npi long, "
                                   "prscrbr_state_abrvtn string")
    alert = sinks.alert_messages(surveillance.alerts(alerts)).first()
    assert alert.key == "1234567890"
    assert json.loads(alert.value)["alert_type"] == "opioid_overutilization"


def test_key_by_keeps_states_together(spark):
    df = spark.range(300).select(F.concat(F.lit("S"), (F.col("id") % 7)).alias(
        "prscrbr_state_abrvtn"))
    placed = ev.key_by(df).withColumn("p", F.spark_partition_id())
    assert placed.groupBy("prscrbr_state_abrvtn").agg(
        F.count_distinct("p").alias("n")).filter("n > 1").count() == 0


def test_late_rows_are_those_the_engine_drops(spark, folder):
    hour = dt.timedelta(hours=1)
    batches = [[(0, T0), (1, T0 + 3 * hour)],
               [(2, T0 + 2 * hour), (3, T0 + 2 * hour + dt.timedelta(seconds=1)), (4, T0)],
               [], [(5, T0 + 2 * hour), (6, T0 + 9 * hour)], [(7, T0 + 7 * hour), (8, T0 + 8.5 * hour)]]
    for i, rows in enumerate(batches):
        put(spark, folder, [message(c, 1, at) for c, at in rows] or ["{bad"])
        sinks.late_sink(stream(spark, folder), f"{folder}/out", f"{folder}/c1",
                        available_now=True).awaitTermination()
        # The engine needs a batch without rows, which ends each run, to apply a new watermark.
        unique = ev.dedup_stream(ev.with_watermark(stream(spark, folder)))
        sinks.sink(unique, f"{folder}/unique", f"{folder}/c2",
                   available_now=True).awaitTermination()
        # A batch that is run again finds the mark of the one before it.
        assert spark.read.parquet(f"{folder}/out-marks").filter(f"batch_id = {i}").count() == 1
    out = spark.read.parquet(f"{folder}/out").withColumn("late", F.col("late").cast("boolean"))
    late = sorted(r.claim_id for r in out.filter("late").collect())
    assert late == ["c2", "c4", "c5", "c7"] and out.count() == 9

    kept = {r.claim_id for r in spark.read.parquet(f"{folder}/unique").collect()}
    assert kept == {f"c{i}" for i in range(9)} - set(late)


def test_state_is_touched_and_expires(spark, folder):
    """Buckets are written where events fall, and go once no window reaches them."""
    def stored():
        state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/check")
        return sorted(r[0] for r in state.select("user_map_key.bucket" if "user_map_key" in
                                                 state.columns else "key").collect())
    hour = dt.timedelta(hours=1)
    put(spark, folder, [message(0, 1, T0), message(1, 1, T0), message(2, 1, T0 + 1.5 * hour)])
    assert count_now(spark, folder) == {"c0": 2, "c1": 2, "c2": 1}
    assert len(stored()) == 2
    put(spark, folder, [message(3, 1, T0 + 6 * hour)])
    count_now(spark, folder)
    assert len(stored()) == 1


def test_streamed_claims_meet_the_bulk(spark):
    """A streamed claim and a bulk row of one key leave one Silver row; gaps are filled."""
    landed = ev.decoded(spark.createDataFrame(
        [(message(0, 1, T0),), (message(1, 2, T0),)], "value string"))
    bulk = spark.createDataFrame(
        [(1_000_000_001, "DOE", "J", "X", "tx", "pain", " b ", "G", 3, 1.0, 9.0, 1, 2, 2024)],
        "prscrbr_npi long, prscrbr_last_org_name string, prscrbr_first_name string, prscrbr_city "
        "string, prscrbr_state_abrvtn string, prscrbr_type string, brnd_name string, gnrc_name "
        "string, tot_clms int, tot_30day_fills double, tot_drug_cst double, tot_day_suply int, "
        "tot_benes int, year int")
    both = cleaning.union_landing(bulk, cleaning.event_claims(landed))
    rows = {r.prscrbr_npi: r for r in cleaning.clean_prescriber_drug(both).collect()}
    assert len(rows) == 2 and rows[1_000_000_002].tot_benes == 0
    assert rows[1_000_000_001].prscrbr_last_org_name is None
    bulk_first = cleaning.clean_prescriber_drug(both, [F.desc_nulls_last("prscrbr_last_org_name")])
    assert bulk_first.filter("prscrbr_npi = 1000000001").first().tot_clms == 3


def test_prescribers_share_state(spark, folder):
    """State entries, each of which costs messages to the store, are fewer than prescribers."""
    rows = [(i, i % 1500, T0 + dt.timedelta(minutes=i * 7 % 100)) for i in range(3000)]
    put(spark, folder, [message(*r) for r in rows])
    streamed = count_now(spark, folder)
    batch = surveillance.trailing_count(
        spark.createDataFrame([(f"c{i}", n, t) for i, n, t in rows],
                              "claim_id string, npi long, ts timestamp"), "npi", "ts", 60, "n")
    assert streamed == {r.claim_id: r.n for r in batch.collect()}
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/check")
    assert state.count() < 1500


def test_counted_events_keep_their_fields(spark, folder):
    """Missing prescribers count as one, and text of any kind comes back as it was."""
    before = T0.replace(year=1975)
    rows = [('a"b\\\n', None, None, T0), (None, None, "T,X", T0), ("é\u2028", 7, "TX", T0),
            ("x", 7, "", before), ("y", 7, "TX", before + dt.timedelta(microseconds=1))]
    schema = "claim_id string, prscrbr_npi long, prscrbr_state_abrvtn string, event_time timestamp"
    spark.createDataFrame(rows, schema).withColumn("is_opioid", F.lit(True)).coalesce(1) \
        .write.parquet(f"{folder}/in")
    events = spark.readStream.schema(f"{schema}, is_opioid boolean").parquet(f"{folder}/in")
    counts = tracker.trailing_counts(ev.with_watermark(events), 60)
    assert counts.schema == tracker.COUNT_SCHEMA
    sinks.sink(counts, f"{folder}/out", f"{folder}/check", available_now=True).awaitTermination()
    out = spark.read.schema(tracker.COUNT_SCHEMA).parquet(f"{folder}/out").collect()
    assert {tuple(r)[:5] for r in out} == {(*r, n) for r, n in zip(rows, (2, 2, 1, 1, 2), strict=True)}


@pytest.mark.parametrize("seed", range(5))
def test_events_between(seed):
    rng = np.random.default_rng(seed)
    parts = [(rng.integers(-2, 3, n), rng.integers(-50, 50, n), rng.integers(1, 4, n))
             for n in (0, 7, 80)]
    known = tracker._merged(parts)
    plain = [row for part in parts for row in zip(*(x.tolist() for x in part), strict=True)]
    pairs = list(zip(known[0].tolist(), known[1].tolist(), strict=True))
    assert pairs == sorted({r[:2] for r in plain}) and known[2].sum() == sum(r[2] for r in plain)
    npi, last = rng.choice(known[0], 60), rng.integers(-60, 60, 60)
    got = tracker._events_between(known, npi, last - 20, last)
    assert got.tolist() == [sum(n for who, at, n in plain if who == i and t - 20 <= at <= t)
                            for i, t in zip(npi, last, strict=True)]


def test_messages_arrive_in_several_files_at_a_time(spark, folder, monkeypatch):
    """Equally many files for each arrival, in order, with a file in place of each empty part."""
    monkeypatch.setattr(queries, "MESSAGES_PER_FILE", 10, raising=False)
    small = "/root/testdata/sf0.001"
    delayed = F.col("claim_id").cast("bigint") % 50 == 0
    queries._arrivals(spark, small, folder, late=delayed)
    days = F.floor(F.unix_seconds(F.col("event_time").cast("timestamp")) / (8 * 86_400))
    sent = testdata.claim_messages(spark, small).select(
        (days + delayed.cast("int")).alias("arrival"), "value").collect()
    arrivals = sorted({r.arrival for r in sent})
    files = sorted(Path(f"{folder}/in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    together, rest = divmod(len(files), len(arrivals))
    assert together > 1 and not rest
    sizes = []
    for i, arrival in enumerate(arrivals):
        read = [[r.value for r in spark.read.parquet(str(f)).collect()]
                for f in files[i * together:(i + 1) * together]]
        assert sorted(sum(read, [])) == sorted(r.value for r in sent if r.arrival == arrival)
        sizes += map(len, read)
    assert 0 in sizes and max(sizes) < 40
