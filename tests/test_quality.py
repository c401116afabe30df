import os

import pytest
from pyspark.sql import functions as F

from scriptwell.operators import quality as q


def passed(df):
    return {r.check_name: r.passed for r in df.collect()}


def test_silver_suite_on_clean_rows(silver):
    assert all(passed(q.silver_suite(silver)).values())


def test_silver_suite_finds_faults(spark, silver):
    bad = silver.unionByName(silver.limit(1)).withColumn(
        "prscrbr_state_abrvtn", F.lit("ZZ")).withColumn("tot_clms", F.lit(-1))
    results = {r.check_name: r for r in q.silver_suite(bad).collect()}
    assert not results["no_duplicate_keys"].passed
    assert results["no_duplicate_keys"].details.endswith(": 1")
    assert not results["valid_state_codes"].passed and not results["tot_clms_in_range"].passed
    assert results["valid_state_codes"].severity == "warning"


def test_nulls_pass_ranges_but_are_key_values(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "k string, v int")
    results = passed(q.run_checks(df, "s", "t", [
        q.value_range("v", 0, 1), q.valid_state_codes("k"), q.no_duplicate_keys(["k"]),
        q.no_null_key("k"), q.expect_unique("k"), q.expect_regex("k", "x")]))
    assert results == {
        "v_in_range": True, "valid_state_codes": True, "no_duplicate_keys": False,
        "no_null_k": False, "expect_column_values_to_be_unique(k)": True,
        "expect_column_values_to_match_regex(k)": True}


def test_checks_on_missing_columns(spark):
    df = spark.range(1)
    results = q.run_checks(df, "s", "t", [q.not_empty(), q.no_null_key("nope")])
    assert passed(results) == {"table_not_empty": True}
    assert passed(q.run_checks(df, "s", "t", [q.required_columns(df, ["id", "nope"])])) == {
        "required_columns_present": False}
    lost = q.run_checks(df, "s", "t", [q.expect_not_null("id"), q.expect_unique("nope"),
                                       q.no_duplicate_keys(["id", "nope"])])
    assert sorted(map(tuple, lost.select("passed", "details").collect())) == [
        (False, "Column absent: nope"), (False, "Column absent: nope"),
        (True, "Unexpected rows: 0")]
    with pytest.raises(q.QualityGateError):
        q.gate(lost)


def test_bronze_floor_and_empty_table(spark):
    empty = spark.createDataFrame([], "gnrc_name string")
    results = passed(q.bronze_suite({"drug": empty}, {"drug": ("gnrc_name", 0)}))
    assert results == {"table_not_empty": False, "no_null_gnrc_name": True,
                       "row_count_not_dropped": True}


def test_expectations_count(silver):
    results = passed(q.silver_expectations(silver, (1, 10)))
    assert len(results) == 15 and all(results.values())
    assert not passed(q.silver_expectations(silver))["expect_table_row_count_to_be_between"]


def test_one_scan_per_suite(silver):
    plan = q.silver_expectations(silver)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_all_suites_scan_a_table_once(silver):
    people = silver.select("prscrbr_npi").distinct()
    results = q.all_suites(silver, {"silver_prescriber": people, "silver_prescriber_drug": silver},
                           (1, 10))
    apart = q.silver_suite(silver).unionByName(q.silver_expectations(silver, (1, 10))).unionByName(
        q.all_model_tests({"silver_prescriber": people, "silver_prescriber_drug": silver}))
    assert sorted(map(tuple, results.collect())) == sorted(map(tuple, apart.collect()))
    plan = results._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2


def test_gate(silver):
    assert q.gate(q.silver_suite(silver)) == []
    warned = silver.withColumn("prscrbr_state_abrvtn", F.lit("ZZ"))
    assert q.gate(q.silver_suite(warned)) == ["prescriber_drug.valid_state_codes"]
    with pytest.raises(q.QualityGateError, match="required_columns_present"):
        q.gate(q.silver_suite(silver.drop("gnrc_name")))


def test_scorecard(silver):
    warned = silver.withColumn("prscrbr_state_abrvtn", F.lit("ZZ"))
    rows = {r.suite: r for r in q.scorecard(q.silver_suite(warned)).collect()}
    assert rows["TOTAL"].total == 5 and rows["TOTAL"].warnings == 1
    assert rows["silver"].critical_failures == 0


def test_singular_tests(spark):
    drugs = spark.createDataFrame([("A", 2023, True, 10_000.0), ("B", 2023, True, 10_000.5),
                                   ("C", 2023, False, 99_999.0)],
                                  "gnrc_name string, year int, is_generic boolean, "
                                  "avg_cost_per_claim double")
    assert [r.gnrc_name for r in q.assert_generic_cost_sanity(drugs).collect()] == ["B"]
    states = spark.createDataFrame([("TX", 2023, 1.0, 0), ("FL", 2023, 0.0, 0)],
                                   "state_abrvtn string, year int, total_cost_usd double, "
                                   "total_prescribers int")
    assert q.assert_no_cost_without_prescribers(states).count() == 1


def test_mean_and_min_on_empty_table_fail(spark):
    empty = spark.createDataFrame([], "v double")
    assert set(passed(q.run_checks(empty, "s", "t", [
        q.expect_mean_between("v", 1, 2), q.expect_min_greater_than("v", 0)])).values()) == {False}


def test_gate_inside_the_plan(silver, folder):
    assert q.gated(silver, q.silver_suite(silver)).count() == silver.count()
    bad = silver.drop("gnrc_name")
    with pytest.raises(Exception, match="critical checks failed: .*required_columns_present"):
        q.gated(bad, q.silver_suite(bad)).write.parquet(f"{folder}/out")
    assert not os.path.exists(f"{folder}/out/_SUCCESS")
