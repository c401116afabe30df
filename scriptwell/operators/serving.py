"""Analytic reads over the Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.functions.columns import (
    exact_avg,
    exact_sum,
    label_generic,
    masked,
    optional_eq,
    sum_if,
)
from scriptwell.fixed_values import MASK_TEXT, ROLES_SEEING_IDENTIFIERS

MAX_DRUG_ROWS = 500
MAX_PRESCRIBER_ROWS = 1000
DRUG_COLUMNS = [
    "gnrc_name", "brnd_name", "year", "is_generic", "total_claims", "total_cost_usd",
    "total_beneficiaries", "avg_cost_per_claim", "unique_prescribers", "cost_rank",
]
PRESCRIBER_COLUMNS = [
    "prscrbr_npi", "prscrbr_last_org_name", "prscrbr_first_name", "prscrbr_city",
    "prscrbr_state_abrvtn", "prscrbr_type", "total_claims", "total_cost_usd",
    "total_beneficiaries", "unique_drugs_prescribed", "generic_rate", "state_rank", "year",
]
STATE_COLUMNS = [
    "state_abrvtn", "year", "total_claims", "total_cost_usd", "total_beneficiaries",
    "total_prescribers", "unique_drugs", "avg_cost_per_claim", "cost_per_beneficiary",
    "national_rank", "pain_specialty_claims",
]


def _top(df: DataFrame, metric: str, ties: list[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(metric), *[F.asc(t) for t in ties]).limit(n)


def _checked(limit: int, highest: int) -> int:
    if not 0 <= limit <= highest:
        raise ValueError(f"limit must lie between 0 and {highest}")
    return limit


def get_drug_summary(drugs: DataFrame, year: int | None = None, limit: int = 50) -> DataFrame:
    rows = optional_eq(drugs, "year", year).select(*DRUG_COLUMNS)
    return _top(rows, "total_cost_usd", ["gnrc_name", "brnd_name", "year"],
                _checked(limit, MAX_DRUG_ROWS))


def generic_vs_brand(drugs: DataFrame, year: int | None = None) -> DataFrame:
    return optional_eq(drugs, "year", year).groupBy("is_generic").agg(
        F.sum("total_claims").alias("total_claims"),
        exact_sum("total_cost_usd").alias("total_cost_usd"),
    )


def labelled_split(drugs: DataFrame, year: int | None = None) -> DataFrame:
    """Spend per flag under its display label."""
    return generic_vs_brand(drugs, year).select(
        label_generic("is_generic").alias("name"), F.col("total_cost_usd").alias("value"))


def get_drug_detail(drugs: DataFrame, drug_name: str) -> DataFrame:
    matching = drugs.filter(F.upper("gnrc_name") == F.upper(F.lit(drug_name)))
    return matching.orderBy(F.desc("year"), "brnd_name")


def get_top_prescribers(prescribers: DataFrame, state: str | None = None,
                        year: int | None = None, limit: int = 100) -> DataFrame:
    rows = optional_eq(optional_eq(prescribers, "prscrbr_state_abrvtn", state), "year", year)
    return _top(rows.select(*PRESCRIBER_COLUMNS), "total_cost_usd", ["prscrbr_npi", "year"],
                _checked(limit, MAX_PRESCRIBER_ROWS))


def get_state_kpi(states: DataFrame, year: int | None = None) -> DataFrame:
    rows = optional_eq(states, "year", year).select(*STATE_COLUMNS)
    return rows.orderBy(F.desc("total_cost_usd"), "state_abrvtn", "year")


def get_prescriber_detail(prescribers: DataFrame, npi: int) -> DataFrame:
    return prescribers.filter(F.col("prscrbr_npi") == F.lit(npi)).orderBy(F.desc("year"))


def search_prescribers(prescribers: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring of the full name, the state or the specialty."""
    wanted = q.lower()
    name = F.lower(F.concat(
        F.coalesce("prscrbr_first_name", F.lit("")), F.lit(" "),
        F.coalesce("prscrbr_last_org_name", F.lit(""))))
    others = [F.lower(F.coalesce(c, F.lit(""))) for c in ("prscrbr_state_abrvtn", "prscrbr_type")]
    found = name.contains(wanted)
    for text in others:
        found = found | text.contains(wanted)
    return prescribers.filter(found)


def kpi_totals(states: DataFrame, year: int | None = None) -> DataFrame:
    return optional_eq(states, "year", year).agg(
        exact_sum("total_cost_usd").alias("total_spend"),
        F.sum("total_beneficiaries").alias("total_benes"),
        F.sum("total_claims").alias("total_claims"),
    )


def avg_generic_rate(prescribers: DataFrame, year: int | None = None) -> DataFrame:
    return optional_eq(prescribers, "year", year).agg(
        exact_avg("generic_rate").alias("avg_generic_rate"))


def kpi_cards(states: DataFrame, prescribers: DataFrame, year: int | None = None,
              limit: int | None = None, prescriber_limit: int | None = None) -> DataFrame:
    """Dashboard totals as (metric, value) rows; limits give the top-n variant.

    A missing rate counts as zero here, unlike in `avg_generic_rate`.
    """
    listed = get_state_kpi(states, year)
    listed = listed if limit is None else listed.limit(limit)
    people = optional_eq(prescribers, "year", year)
    if prescriber_limit is not None:
        people = get_top_prescribers(prescribers, year=year, limit=prescriber_limit)
    sums = listed.agg(
        exact_sum("total_cost_usd").alias("total_cost"),
        F.sum("total_beneficiaries").cast("double").alias("total_beneficiaries"),
        F.sum("total_claims").cast("double").alias("total_claims"),
    )
    rate = people.agg(
        F.round(exact_avg(F.coalesce("generic_rate", F.lit(0.0))), 1).alias("avg_generic_rate"))
    return _as_rows(sums).unionByName(_as_rows(rate))


def _as_rows(one_row: DataFrame) -> DataFrame:
    return one_row.unpivot([], one_row.columns, "metric", "value")


def year_trend(states: DataFrame) -> DataFrame:
    return states.groupBy("year").agg(exact_sum("total_cost_usd").alias("total_cost_usd"))


def claim_share(drugs: DataFrame, year: int | None = None) -> DataFrame:
    counts = optional_eq(drugs, "year", year).groupBy("is_generic").agg(
        F.sum("total_claims").alias("total_claims"))
    everything = F.sum("total_claims").over(Window.partitionBy())
    return counts.withColumn(
        "claim_share", F.try_divide(F.col("total_claims").cast("double"), everything))


def opioid_by_state(states: DataFrame, year: int | None = None, limit: int = 5) -> DataFrame:
    rows = optional_eq(states, "year", year)
    return _top(rows, "pain_specialty_claims", ["state_abrvtn", "year"], limit).select(
        "state_abrvtn", "pain_specialty_claims", "total_claims")


def avg_cost(states: DataFrame, year: int | None = None, limit: int = 10) -> DataFrame:
    rows = optional_eq(states, "year", year)
    return _top(rows, "avg_cost_per_claim", ["state_abrvtn", "year"], limit).select(
        "state_abrvtn", "avg_cost_per_claim", "cost_per_beneficiary")


def top_states(states: DataFrame, year: int | None = None, limit: int = 5) -> DataFrame:
    rows = optional_eq(states, "year", year)
    return _top(rows, "total_cost_usd", ["state_abrvtn", "year"], limit)


def top_drugs(drugs: DataFrame, year: int | None = None, limit: int = 10) -> DataFrame:
    rows = optional_eq(drugs, "year", year)
    return _top(rows, "total_cost_usd", ["gnrc_name", "brnd_name", "year"], limit)


def top_prescribers(prescribers: DataFrame, year: int | None = None, limit: int = 10) -> DataFrame:
    rows = optional_eq(prescribers, "year", year)
    return _top(rows, "total_cost_usd", ["prscrbr_npi", "year"], limit)


# Named reads behind the question intents: Gold table, then rows for one year.
CANNED_QUERIES = {
    "top_state": ("state_kpi", lambda t, year: top_states(t, year).select(
        "state_abrvtn", "total_cost_usd", "total_beneficiaries")),
    "top_drugs": ("drug_summary", lambda t, year: top_drugs(t, year).select(
        "gnrc_name", "brnd_name", "total_cost_usd", "total_claims")),
    "generic_vs_brand": ("drug_summary", generic_vs_brand),
    "top_prescribers": ("prescriber_summary", lambda t, year: top_prescribers(t, year).select(
        "prscrbr_last_org_name", "prscrbr_state_abrvtn", "total_cost_usd", "generic_rate")),
    "opioid_by_state": ("state_kpi", opioid_by_state),
    "avg_cost": ("state_kpi", avg_cost),
}


def canned_query(key: str, year: int, gold: dict[str, DataFrame]) -> DataFrame:
    table, read = CANNED_QUERIES[key]
    return read(gold[table], year)


def prescriber_with_state(prescribers: DataFrame, states: DataFrame) -> DataFrame:
    """Prescriber rows beside their state's totals of the same year."""
    context = states.select(
        F.col("state_abrvtn").alias("prscrbr_state_abrvtn"), "year",
        F.col("total_cost_usd").alias("state_cost_usd"), "national_rank")
    joined = prescribers.select(
        "prscrbr_npi", "year", "prscrbr_state_abrvtn", "total_cost_usd"
    ).join(context, ["prscrbr_state_abrvtn", "year"], "left")
    return joined.withColumn(
        "state_cost_share", F.try_divide(F.col("total_cost_usd"), F.col("state_cost_usd")))


def drug_with_year(drugs: DataFrame, states: DataFrame) -> DataFrame:
    """Drug rows beside national totals; states are summed to one row per year first,
    since a plain join on the year pairs every drug with every state."""
    national = states.groupBy("year").agg(
        exact_sum("total_cost_usd").alias("national_cost_usd"),
        F.sum("total_beneficiaries").alias("national_beneficiaries"))
    return drugs.select("gnrc_name", "brnd_name", "year", "is_generic", "total_cost_usd").join(
        national, "year", "left")


def masked_view(df: DataFrame, columns: list[str], role: str) -> DataFrame:
    """Identifier columns readable for the admitted roles only."""
    return df.withColumns({
        c: masked(F.col(c).cast("string"), role, ROLES_SEEING_IDENTIFIERS, MASK_TEXT)
        for c in columns
    })


def region_view(df: DataFrame, entitlements: DataFrame, user: str,
                state_column: str = "prscrbr_state_abrvtn") -> DataFrame:
    """Rows of the states a user is entitled to."""
    allowed = entitlements.filter(F.col("username") == user).select(
        F.col("state_abrvtn").alias(state_column))
    return df.join(allowed, state_column, "left_semi")


def active_alerts(alerts: DataFrame) -> DataFrame:
    unresolved = F.coalesce(F.col("status") != "RESOLVED", F.lit(True))
    return alerts.groupBy("severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(unresolved).alias("active"),
        sum_if(unresolved, "claim_count_in_window").alias("active_claims"))
