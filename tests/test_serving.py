import pytest
from pyspark.sql import functions as F

from scriptwell.operators import findings, guarded_sql, serving

DRUG = ("gnrc_name string, brnd_name string, year int, is_generic boolean, total_claims long, "
        "total_cost_usd double, total_beneficiaries long, avg_cost_per_claim double, "
        "unique_prescribers long, cost_rank int")
STATE = "state_abrvtn string, year int, total_cost_usd double, cost_per_beneficiary double"
RATES = "prscrbr_state_abrvtn string, year int, generic_rate double"


def drug(name, brand, generic, claims=10, cost=100.0, avg=10.0, year=2023):
    return (name, brand, year, generic, claims, cost, 5, avg, 1, 1)


@pytest.fixture(scope="module")
def drugs(spark):
    return spark.createDataFrame([
        drug("A", "A", True, avg=10.0), drug("A", "BR1", False, avg=12.0),
        drug("A", "BR2", False, 3, 300.0, 30.0), drug("B", "BR3", False, 1, 50.0, 90.0),
        drug("A", "BR2", False, 4, 900.0, 40.0, year=2022)], DRUG)


def test_top_and_optional_year(drugs):
    assert [r.brnd_name for r in serving.get_drug_summary(drugs, 2023, 2).collect()] == ["BR2", "A"]
    assert serving.get_drug_summary(drugs).count() == 5
    with pytest.raises(ValueError):
        serving.get_drug_summary(drugs, limit=501)


def test_lookup_ignores_case_and_lists_newest_first(drugs):
    assert [r.year for r in serving.get_drug_detail(drugs, "a").collect()][-1] == 2022
    assert serving.get_drug_detail(drugs, "none").count() == 0


def test_split_share_and_labels(drugs):
    rows = {r.name: r.value for r in serving.labelled_split(drugs, 2023).collect()}
    assert rows == {"Generic": 100.0, "Brand Name": 450.0}
    assert serving.claim_share(drugs).agg(F.sum("claim_share")).first()[0] == pytest.approx(1)


def test_search_and_mask(spark):
    people = spark.createDataFrame(
        [(1, "Jane", "Doe", "TX", "Pain Management"), (2, None, "Roe", None, "Cardiology")],
        "prscrbr_npi long, prscrbr_first_name string, prscrbr_last_org_name string, "
        "prscrbr_state_abrvtn string, prscrbr_type string")
    found = lambda q: [r[0] for r in serving.search_prescribers(people, q).collect()]
    assert found("NE DO") == [1] and found("tx") == [1] and found("CARD") == [2]
    assert found("") == [1, 2]
    hidden = serving.masked_view(people, ["prscrbr_npi"], "viewer").first()
    shown = serving.masked_view(people, ["prscrbr_npi"], "HEALTHCARE_READER_ADMIN").first()
    assert hidden.prscrbr_npi == "***MASKED***" and shown.prscrbr_npi == "1"


def test_region_view_keeps_entitled_rows_once(spark):
    rows = spark.createDataFrame([("TX",), ("FL",)], "prscrbr_state_abrvtn string")
    rights = spark.createDataFrame([("ann", "TX"), ("ann", "TX"), ("bob", "FL")],
                                   "username string, state_abrvtn string")
    assert [r[0] for r in serving.region_view(rows, rights, "ann").collect()] == ["TX"]


def test_savings_need_more_than_the_factor(drugs):
    rows = findings.savings_pairs(drugs, 2023).collect()
    assert [(r.brnd_name, r.potential_savings) for r in rows] == [("BR2", 60.0)]
    assert findings.total_savings(findings.savings_candidates(drugs)).collect()[0][1] == 60.0


def test_planted_outlier(spark):
    normal = [(f"S{i}", 2023, 100.0 + i, 1.0) for i in range(9)]
    rows = spark.createDataFrame([*normal, ("XX", 2023, 10_000.0, None)], STATE)
    found = findings.zscore_outliers(rows).collect()
    assert [(r.state_abrvtn, r.cost_per_beneficiary) for r in found] == [("XX", 0.0)]
    assert found[0].z_score == 2.85


def test_too_few_rows_equal_values_and_null_cost(spark):
    few = spark.createDataFrame([("A", 2023, 1.0, 1.0), ("B", 2023, 900.0, 1.0)], STATE)
    same = spark.createDataFrame([(c, 2023, 5.0, 1.0) for c in "ABCD"], STATE)
    null = spark.createDataFrame(
        [(c, 2023, 100.0, 1.0) for c in "ABCDEFGHI"] + [("Z", 2023, None, 1.0)], STATE)
    assert findings.zscore_outliers(few).count() == 0
    assert findings.zscore_outliers(same).count() == 0
    assert [r.state_abrvtn for r in findings.zscore_outliers(null).collect()] == ["Z"]


def test_low_adoption_counts_missing_rates_as_zero(spark):
    rows = spark.createDataFrame(
        [("TX", 2023, 80.0), ("TX", 2023, 80.0), ("FL", 2023, None), (None, 2023, 10.0)], RATES)
    low = findings.low_adoption_states(rows).collect()
    assert [(r.prscrbr_state_abrvtn, r.state_generic_rate, r.national_avg_rate) for r in low] == [
        ("FL", 0.0, 42.5), ("Unknown", 10.0, 42.5)]
    assert serving.avg_generic_rate(rows).first()[0] == pytest.approx(170 / 3)


def test_duplicate_groups(drugs):
    doubled = drugs.unionByName(drugs.filter("brnd_name = 'BR1'"))
    row = findings.duplicate_groups(doubled, "t", findings.GOLD_KEYS["drug_summary"]).first()
    assert row.duplicate_key_groups == 1


def test_active_alerts(spark):
    alerts = spark.createDataFrame(
        [("high", "RESOLVED", 30), ("high", "ACTIVE", 40), ("medium", None, 16)],
        "severity string, status string, claim_count_in_window long")
    rows = {r.severity: r for r in serving.active_alerts(alerts).collect()}
    assert (rows["high"].alerts, rows["high"].active, rows["medium"].active) == (2, 1, 1)


@pytest.mark.parametrize("sql", [
    "DROP TABLE t", "DELETE FROM t WHERE year = 2023", "UPDATE t SET a = 0",
    "INSERT INTO t VALUES (1,2,3)", "TRUNCATE TABLE t", "ALTER TABLE t DROP COLUMN a",
    "CREATE TABLE evil AS SELECT * FROM t", "GRANT ALL ON t TO PUBLIC",
    "SELECT * FROM t; DROP TABLE t;", "SELECT 1; SELECT 2",
    "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT * FROM t WHERE merge = 1", "",
])
def test_unsafe_sql(sql):
    with pytest.raises(guarded_sql.UnsafeSQLError):
        guarded_sql.validate_sql(sql)


def test_safe_sql():
    check = guarded_sql.validate_sql
    assert check("SELECT * FROM t LIMIT 50") == "SELECT * FROM t LIMIT 50"
    assert check(" select a from t ; ") == "select a from t  LIMIT 200"
    assert check("SELECT COUNT(*) FROM t") == "SELECT COUNT(*) FROM t"
    assert check("SELECT updated_at FROM t").endswith("LIMIT 200")
    assert check("SELECT a FROM t LIMIT :n") == "SELECT a FROM t LIMIT :n"


@pytest.mark.parametrize("sql", [
    "SELECT id, 'LIMIT 5' AS note FROM many", "SELECT id AS credit_limit FROM many",
    "SELECT id AS `limit 5` FROM many", "SELECT id FROM many -- LIMIT 5",
    "SELECT id FROM many /* count(1)\n */", 'SELECT id, "sum(x)" AS s FROM many',
    "SELECT id, 'it\\'s LIMIT 3' AS s FROM many", "SELECT id AS limit FROM many",
])
def test_quoted_limits_do_not_evade_the_cap(spark, sql):
    spark.range(500).createOrReplaceTempView("many")
    assert guarded_sql.run_guarded(spark, sql).count() == 200


def test_guarded_rows_and_log(spark, folder):
    spark.range(500).createOrReplaceTempView("numbers")
    assert guarded_sql.run_guarded(spark, "SELECT id FROM numbers").count() == 200
    assert guarded_sql.run_guarded(
        spark, "SELECT id FROM numbers WHERE id < :n", {"n": 3}).count() == 3
    guarded_sql.log_query(spark, f"{folder}/log", "ann", "how many", "SELECT 1", 1, "success")
    guarded_sql.log_query(spark, f"{folder}/log", "ann", "drop", "DROP", 0, "rejected")
    assert spark.read.parquet(f"{folder}/log").groupBy("status").count().count() == 2


def test_logged_runs(spark, folder):
    """Each outcome leaves its row; a capped statement counts the rows it gave."""
    spark.range(500).createOrReplaceTempView("many_rows")
    run = lambda sql: guarded_sql.run_logged(spark, f"{folder}/log", "ann", "?", sql)
    assert run("SELECT id FROM many_rows").count() == 200
    assert run("DELETE FROM many_rows") is None and run("SELECT x FROM many_rows") is None
    assert run("SELECT CAST(raise_error('no') AS INT) AS x FROM many_rows") is None
    log = spark.read.parquet(f"{folder}/log").collect()
    assert sorted((r.status, r.row_count) for r in log) == [
        ("failed", 0), ("failed", 0), ("rejected", 0), ("success", 200)]
