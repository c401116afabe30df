"""Data-quality checks, suites, scorecard and gate.

A check is an aggregate and a verdict on it. All checks of a table run in one `agg`, so
a suite scans its table once however many checks it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptwell.fixed_values import (
    BRONZE_EXPECTATIONS,
    GENERIC_COST_CEILING,
    SILVER_REQUIRED_COLUMNS,
    SILVER_ROW_BOUNDS,
    STATE_CODES,
)
from scriptwell.functions.columns import exact_avg
from scriptwell.operators.cleaning import CLAIM_KEY

CRITICAL, WARNING = "critical", "warning"


@dataclass(frozen=True)
class Check:
    """`measure` is aggregated over the table; `verdict` and `details` read the measure.

    A table without the columns it `needs` fails the check, or is not checked if it `skips`.
    """

    name: str
    severity: str
    measure: Column
    verdict: object
    details: object
    needs: tuple[str, ...] = field(default=())
    skips: bool = False


def _all_rows() -> Column:
    return F.count(F.lit(1))


def _zero(label: str):
    return (lambda m: m == 0), (lambda m: F.format_string(f"{label}: %,d", m))


def _failing(name: str, severity: str, predicate: Column, label: str, *needs: str,
             skips: bool = False) -> Check:
    """No row may satisfy the predicate; a null predicate passes."""
    verdict, details = _zero(label)
    return Check(name, severity, F.count_if(predicate), verdict, details, needs, skips)


# ---- scalar checks -------------------------------------------------------------------

def not_empty() -> Check:
    return Check("table_not_empty", CRITICAL, _all_rows(), lambda m: m > 0,
                 lambda m: F.format_string("Row count: %,d", m))


def no_null_key(key: str) -> Check:
    return _failing(f"no_null_{key}", CRITICAL, F.col(key).isNull(), f"Null {key} count", key,
                    skips=True)


def no_duplicate_keys(keys: Sequence[str]) -> Check:
    """Rows beyond one per key; null is a key value like any other."""
    surplus = _all_rows() - F.count_distinct(F.struct(*keys))
    verdict, details = _zero(f"Duplicate rows on {', '.join(keys)}")
    return Check("no_duplicate_keys", WARNING, surplus, verdict, details, tuple(keys))


def value_range(column: str, low, high) -> Check:
    outside = (F.col(column) < low) | (F.col(column) > high)
    return _failing(f"{column}_in_range", WARNING, outside, f"Rows outside [{low}, {high}]", column,
                    skips=True)


def row_count_floor(expected: int) -> Check:
    return Check("row_count_not_dropped", CRITICAL, _all_rows(), lambda m: m >= expected,
                 lambda m: F.format_string(f"Row count %,d vs expected minimum {expected:,}", m))


def required_columns(df: DataFrame, columns: Sequence[str]) -> Check:
    missing = missing_columns(columns, df.columns)
    text = f"Missing columns: {', '.join(missing)}" if missing else "All required columns present"
    return Check("required_columns_present", CRITICAL, F.max(F.lit(len(missing))),
                 lambda m: F.lit(not missing), lambda m: F.lit(text))


def missing_columns(required: Sequence[str], present: Sequence[str]) -> list[str]:
    return [c for c in required if c not in set(present)]


def valid_state_codes(column: str) -> Check:
    return _failing("valid_state_codes", WARNING, ~F.col(column).isin(STATE_CODES),
                    "Rows with invalid state code", column, skips=True)


# ---- expectations --------------------------------------------------------------------

def expect_column_to_exist(df: DataFrame, column: str) -> Check:
    present = column in df.columns
    return Check(f"expect_column_to_exist({column})", CRITICAL, F.max(F.lit(present)),
                 lambda m: F.lit(present), lambda m: F.lit("present" if present else "absent"))


def expect_not_null(column: str) -> Check:
    return _failing(f"expect_column_values_to_not_be_null({column})", CRITICAL,
                    F.col(column).isNull(), "Unexpected rows", column)


def expect_compound_unique(columns: Sequence[str]) -> Check:
    base = no_duplicate_keys(columns)
    name = f"expect_compound_columns_to_be_unique({', '.join(columns)})"
    return Check(name, CRITICAL, base.measure, base.verdict, base.details, base.needs)


def expect_unique(column: str) -> Check:
    """Non-null values occur once."""
    surplus = F.count(column) - F.count_distinct(column)
    verdict, details = _zero("Surplus rows")
    return Check(f"expect_column_values_to_be_unique({column})", CRITICAL, surplus, verdict,
                 details, (column,))


def expect_between(column: str, low=None, high=None) -> Check:
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < low)
    if high is not None:
        outside = outside | (F.col(column) > high)
    return _failing(f"expect_column_values_to_be_between({column})", CRITICAL, outside,
                    "Unexpected rows", column)


def expect_regex(column: str, pattern: str) -> Check:
    return _failing(f"expect_column_values_to_match_regex({column})", CRITICAL,
                    ~F.col(column).cast("string").rlike(pattern), "Unexpected rows", column)


def expect_in_set(column: str, values: Sequence) -> Check:
    return _failing(f"expect_column_values_to_be_in_set({column})", CRITICAL,
                    ~F.col(column).isin(list(values)), "Unexpected rows", column)


def expect_mean_between(column: str, low: float, high: float) -> Check:
    mean = exact_avg(column)
    return Check(f"expect_column_mean_to_be_between({column})", CRITICAL, mean,
                 lambda m: F.coalesce(m.between(low, high), F.lit(False)),
                 lambda m: F.format_string("Mean: %.2f", m), (column,))


def expect_row_count_between(low: int, high: int) -> Check:
    return Check("expect_table_row_count_to_be_between", CRITICAL, _all_rows(),
                 lambda m: m.between(low, high), lambda m: F.format_string("Row count: %,d", m))


def expect_min_greater_than(column: str, bound: float) -> Check:
    return Check(f"expect_column_min_to_be_greater_than({column})", CRITICAL, F.min(column),
                 lambda m: F.coalesce(m > bound, F.lit(False)),
                 lambda m: F.format_string("Min: %.2f", m.cast("double")), (column,))


# ---- running -------------------------------------------------------------------------

Suite = tuple[str, str, Sequence[Check]]


def run_checks(df: DataFrame, suite: str, table: str, checks: Sequence[Check]) -> DataFrame:
    """One result row per check. Where the table lacks a column, a check that skips has no row and
    any other fails."""
    return run_suites(df, [(suite, table, checks)])


def run_suites(df: DataFrame, suites: Sequence[Suite]) -> DataFrame:
    """Result rows of several suites over one table: (suite, name of the table in it, checks).

    All measures are one aggregate, which computes those that suites share once.
    """
    checks = [(suite, table, c) for suite, table, own in suites for c in own]
    absent = [missing_columns(c.needs, df.columns) for _, _, c in checks]
    measures = [c.measure.alias(f"m{i}") for i, (_, _, c) in enumerate(checks) if not absent[i]]
    measured = df.agg(*measures, _all_rows().alias("rows"))
    results = [
        F.struct(
            F.lit(suite).alias("suite"), F.lit(table).alias("table"),
            F.lit(c.name).alias("check_name"),
            (F.lit(False) if absent[i] else c.verdict(F.col(f"m{i}"))).alias("passed"),
            F.lit(c.severity).alias("severity"),
            (F.lit(f"Column absent: {', '.join(absent[i])}") if absent[i]
             else c.details(F.col(f"m{i}"))).alias("details"),
        ) for i, (suite, table, c) in enumerate(checks) if not (absent[i] and c.skips)
    ]
    return measured.select(F.inline(F.array(*results))).select(
        "suite", "table", "check_name", "passed", "severity", "details")


def _union(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def bronze_suite(tables: dict[str, DataFrame],
                 expectations: dict[str, tuple[str, int]] = BRONZE_EXPECTATIONS) -> DataFrame:
    return _union([
        run_checks(tables[name], "bronze", name,
                   [not_empty(), no_null_key(key), row_count_floor(floor)])
        for name, (key, floor) in expectations.items() if name in tables
    ])


def _silver_suite(claims: DataFrame) -> Suite:
    return "silver", "prescriber_drug", [
        required_columns(claims, SILVER_REQUIRED_COLUMNS),
        no_duplicate_keys(CLAIM_KEY),
        value_range("tot_clms", 0, 10_000_000),
        value_range("avg_cost_per_claim", 0, 500_000),
        valid_state_codes("prscrbr_state_abrvtn"),
    ]


def _silver_expectations(claims: DataFrame, rows: tuple[int, int]) -> Suite:
    return "silver_expectations", "prescriber_drug", [
        *[expect_column_to_exist(claims, c) for c in SILVER_REQUIRED_COLUMNS],
        expect_not_null("prscrbr_npi"),
        expect_not_null("gnrc_name"),
        expect_compound_unique(CLAIM_KEY),
        expect_between("tot_clms", 0, 10_000_000),
        expect_between("tot_drug_cst", 0, 1_000_000_000),
        expect_between("avg_cost_per_claim", 0, 500_000),
        expect_regex("prscrbr_state_abrvtn", "^[A-Z]{2}$"),
        expect_in_set("is_generic", [True, False]),
        expect_mean_between("avg_cost_per_claim", 1, 5000),
        expect_row_count_between(*rows),
    ]


def silver_suite(claims: DataFrame) -> DataFrame:
    return run_suites(claims, [_silver_suite(claims)])


def silver_expectations(claims: DataFrame, rows: tuple[int, int] = SILVER_ROW_BOUNDS) -> DataFrame:
    return run_suites(claims, [_silver_expectations(claims, rows)])


def all_suites(claims: DataFrame, models: dict[str, DataFrame],
               rows: tuple[int, int] = SILVER_ROW_BOUNDS) -> DataFrame:
    """Results of every suite on Silver claims and of the model tests; each table is scanned once."""
    shared = "silver_prescriber_drug"
    return run_suites(claims, [_silver_suite(claims), _silver_expectations(claims, rows),
                               _model_suite(shared)]).unionByName(
        all_model_tests({m: df for m, df in models.items() if m != shared}))


# Model tests by table, under this library's own column names.
MODEL_TESTS = {
    "silver_prescriber_drug": [
        expect_not_null, ["prscrbr_npi", "gnrc_name"], [("tot_drug_cst", 0, None)], None],
    "silver_prescriber": [expect_not_null, ["prscrbr_npi"], [], ["prscrbr_npi"]],
    "drug_summary": [
        expect_not_null, ["gnrc_name", "year", "total_cost_usd", "cost_rank"],
        [("total_cost_usd", 0, None), ("cost_rank", 1, None)], None],
    "state_kpi": [
        expect_not_null, ["state_abrvtn", "total_cost_usd", "national_rank"], [],
        ["state_abrvtn", "year"]],
    "prescriber_summary": [
        expect_not_null, ["prscrbr_npi"], [("generic_rate", 0, 100)], ["prscrbr_npi", "year"]],
}


def _model_suite(model: str) -> Suite:
    null_test, not_null, ranges, unique = MODEL_TESTS[model]
    checks = [null_test(c) for c in not_null]
    checks += [expect_between(c, low, high) for c, low, high in ranges]
    if unique:
        checks.append(expect_compound_unique(unique))
    if model == "state_kpi":
        checks.append(expect_in_set("state_abrvtn", STATE_CODES))
    return "model_tests", model, checks


def model_tests(df: DataFrame, model: str) -> DataFrame:
    return run_suites(df, [_model_suite(model)])


def all_model_tests(models: dict[str, DataFrame]) -> DataFrame:
    return _union([model_tests(models[m], m) for m in MODEL_TESTS if m in models])


def declared_assertions(events: DataFrame, drugs: DataFrame, prescribers: DataFrame,
                        states: DataFrame) -> DataFrame:
    """Assertions on claims, drugs, prescribers and states that no other suite holds."""
    return _union([
        run_checks(events, "declared_claims", "claims", [
            expect_not_null("claim_id"),
            expect_unique("claim_id"),
            expect_between("drug_cost_usd", 0.01, 100_000.0),
            expect_regex("prscrbr_npi", r"^\d{10}$"),
            expect_in_set("prscrbr_state_abrvtn", STATE_CODES),
        ]),
        run_checks(drugs, "declared_gold", "drug_summary", [
            expect_compound_unique(["gnrc_name", "year"]),
            expect_not_null("total_cost_usd"),
        ]),
        run_checks(prescribers, "declared_gold", "prescriber_summary", [
            expect_between("generic_rate", 0.0, 100.0),
        ]),
        run_checks(states, "declared_gold", "state_kpi", [
            expect_unique("state_abrvtn"),
            expect_min_greater_than("total_claims", 1000),
        ]),
    ])


def assert_generic_cost_sanity(drugs: DataFrame, ceiling: float = GENERIC_COST_CEILING) -> DataFrame:
    """Generic rows too dear to be true; no rows means the test passes."""
    return drugs.filter(F.col("is_generic") & (F.col("avg_cost_per_claim") > ceiling)).select(
        "gnrc_name", "year", "avg_cost_per_claim")


def assert_no_cost_without_prescribers(states: DataFrame) -> DataFrame:
    return states.filter((F.col("total_cost_usd") > 0) & (F.col("total_prescribers") == 0)).select(
        "state_abrvtn", "year", "total_cost_usd", "total_prescribers")


def scorecard(results: DataFrame) -> DataFrame:
    """Counts per suite and over all suites, the latter under the name TOTAL."""
    failed = ~F.col("passed")
    return results.rollup("suite").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("severity") == CRITICAL)).alias("critical_failures"),
        F.count_if(failed & (F.col("severity") == WARNING)).alias("warnings"),
    ).withColumn("suite", F.coalesce("suite", F.lit("TOTAL")))


class QualityGateError(RuntimeError):
    """A critical check failed."""


def gate(results: DataFrame) -> list[str]:
    """Raise on a critical failure; otherwise the names of the failed warnings.

    The result table has one row per check, so reading it on the driver is small.
    """
    failed = results.filter(~F.col("passed")).select("severity", "table", "check_name").collect()
    critical = [f"{r.table}.{r.check_name}" for r in failed if r.severity == CRITICAL]
    if critical:
        raise QualityGateError("critical checks failed: " + ", ".join(sorted(critical)))
    return sorted(f"{r.table}.{r.check_name}" for r in failed)


def gated(df: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of df; a critical failure among the results fails whatever reads them.

    The verdict is one value in the plan, so checks and write are one job: a table written from
    this either passed its checks or isn't committed.
    """
    name = F.concat_ws(".", "table", "check_name")
    failed = results.filter(~F.col("passed") & (F.col("severity") == CRITICAL)).agg(
        F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("failed")).scalar()
    stop = F.raise_error(F.concat(F.lit("critical checks failed: "), failed)).cast("string")
    return df.filter(F.when(failed != "", stop).isNull())
