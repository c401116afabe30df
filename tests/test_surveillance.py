import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scriptwell.functions.contract import check_events, parse_time
from scriptwell.operators import surveillance

T0 = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
EVENTS = "id int, npi long, ts timestamp"


def counts(spark, rows, minutes=60):
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    out = surveillance.trailing_count(df, "npi", "ts", minutes, "n")
    return {r.id: r.n for r in out.collect()}


def brute(rows, minutes=60):
    window = dt.timedelta(minutes=minutes)
    return {i: sum(1 for _, k, u in rows if k == npi and t - window <= u <= t)
            for i, npi, t in rows}


def test_window_edge_is_inclusive(spark):
    m = dt.timedelta(minutes=1)
    rows = [(0, 1, T0), (1, 1, T0 + 60 * m), (2, 1, T0 + 60 * m + dt.timedelta(microseconds=1)),
            (3, 1, T0 + 60 * m)]
    assert counts(spark, rows) == brute(rows) == {0: 1, 1: 3, 3: 3, 2: 3}


@pytest.mark.parametrize("minutes", [1, 60, 600])
def test_against_brute_force_with_one_busy_key(spark, minutes):
    random.seed(minutes)
    rows = [(i, random.choice([1, 1, 1, 2, 3]),
             T0 + dt.timedelta(seconds=random.randint(-400_000, 400_000) // random.choice([1, 60])))
            for i in range(700)]
    assert counts(spark, rows, minutes) == brute(rows, minutes)


@pytest.mark.parametrize("n,alerts,severe", [(14, 0, 0), (15, 1, 0), (22, 8, 0), (23, 9, 1)])
def test_threshold_and_severity(spark, n, alerts, severe):
    rows = [(i, 7, T0 + dt.timedelta(seconds=i)) for i in range(n)]
    df = spark.createDataFrame(rows, EVENTS).select(
        F.col("npi").alias("prscrbr_npi"), F.lit("TX").alias("prscrbr_state_abrvtn"), "ts")
    out = surveillance.alerts(surveillance.trailing_count(df, "prscrbr_npi", "ts")).collect()
    assert len(out) == alerts
    assert sum(r.severity == "high" for r in out) == severe


def test_opioid_filter(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "is_opioid boolean")
    assert surveillance.opioid_only(df).count() == 1


GOOD = {
    "claim_id": '"c1"', "prscrbr_npi": "1234567890", "prscrbr_state_abrvtn": '"TX"',
    "gnrc_name": '"OXYCODONE"', "brnd_name": '"OXY"', "is_opioid": "true",
    "drug_cost_usd": "12.5", "claim_timestamp": '"2024-01-01T10:00:00Z"',
}


def message(**changes):
    fields = {k: v for k, v in {**GOOD, **changes}.items() if v is not None}
    return "{" + ", ".join(f'"{k}": {v}' for k, v in fields.items()) + "}"


def errors(spark, text):
    return check_events(spark.createDataFrame([(text,)], "value string")).first().errors


def test_valid_event(spark):
    row = check_events(spark.createDataFrame([(message(),)], "value string")).first()
    assert row.errors == [] and row.prscrbr_npi == 1234567890 and row.drug_cost_usd == 12.5
    assert row.event_time == dt.datetime(2024, 1, 1, 10)


@pytest.mark.parametrize("field", list(GOOD))
def test_missing_field(spark, field):
    assert errors(spark, message(**{field: None})) == [f"Missing required field: {field}"]


@pytest.mark.parametrize("changes,part", [
    ({"claim_id": "5"}, "'claim_id' has wrong type: expected string, got bigint"),
    ({"prscrbr_npi": '"1234567890"'}, "'prscrbr_npi' has wrong type: expected integer"),
    ({"prscrbr_npi": "true"}, "'prscrbr_npi' has wrong type"),
    ({"is_opioid": "1"}, "'is_opioid' has wrong type: expected boolean, got bigint"),
    ({"drug_cost_usd": "true"}, "'drug_cost_usd' has wrong type: expected number, got boolean"),
    ({"gnrc_name": "null"}, "'gnrc_name' has wrong type: expected string, got void"),
    ({"prscrbr_state_abrvtn": '"ZZ"'}, "Invalid state code: ZZ"),
    ({"drug_cost_usd": "-1"}, "cannot be negative"),
    ({"drug_cost_usd": "1000001"}, "exceeds sane upper bound"),
    ({"prscrbr_npi": "123456789"}, "must be a 10-digit NPI"),
    ({"prscrbr_npi": "12345678901"}, "must be a 10-digit NPI"),
    ({"claim_timestamp": '"yesterday"'}, "valid ISO 8601"),
    ({"claim_timestamp": '"2024-13-01T00:00:00"'}, "valid ISO 8601"),
])
def test_single_violation(spark, changes, part):
    found = errors(spark, message(**changes))
    assert len(found) == 1 and part in found[0]


@pytest.mark.parametrize("changes", [
    {"drug_cost_usd": "0"}, {"drug_cost_usd": "1000000"}, {"drug_cost_usd": "1e3"},
    {"prscrbr_npi": "9999999999"}, {"prscrbr_npi": "1000000000"},
    {"claim_timestamp": '"2024-01-01T10:00:00.123+02:00"'}, {"claim_timestamp": '"2024-01-01"'},
    {"_produced_at": '"x"'},
])
def test_accepted_edges(spark, changes):
    assert errors(spark, message(**changes)) == []


def test_timestamp_forms(spark):
    """Basic and extended forms name the same instant; what is no timestamp has none."""
    forms = ["2024-03-05T10:11:12.5+02:00", "20240305T101112.5+0200", "2024-03-05T101112,5+02",
             "20240305 10:11:12.5+02:00", "2024-03-05T08:11:12.5Z", "20240305T081112,5Z"]
    short = ["20240305", "2024-03-05T00", "20240305T0000", "2024-03-05 000000Z"]
    wrong = ["2024-W10-2", "2024030", "20241305", "20240305T2511", "2024-0305", "20240305T1",
             "20240305x", "1,5", ""]
    frame = spark.createDataFrame([(t,) for t in [*forms, *short, *wrong]], "t string")
    found = {r.t: r.at for r in frame.select(
        "t", F.unix_millis(parse_time(F.col("t"))).alias("at")).collect()}
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert zone == "UTC"
    assert {found[t] for t in forms} == {1709626272500}
    assert {found[t] for t in short} == {1709596800000}
    assert {found[t] for t in wrong} == {None}


def test_all_violations_are_collected(spark):
    found = errors(spark, message(brnd_name=None, prscrbr_state_abrvtn="null", drug_cost_usd="-5"))
    assert found == [
        "Field 'prscrbr_state_abrvtn' has wrong type: expected string, got void",
        "Missing required field: brnd_name", "Invalid state code: null",
        "drug_cost_usd cannot be negative"]


@pytest.mark.parametrize("text", ["{bad", "", None])
def test_malformed(spark, text):
    assert errors(spark, text) == ["malformed JSON"]
