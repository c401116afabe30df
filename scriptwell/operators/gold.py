"""Yearly KPI tables: by drug, by prescriber and by state.

Each table starts with a map-side aggregation, so a key with a large share of the
claims leaves every task as one partial row. Exact distinct counts ride on the same
pass: Spark first groups by (key, counted value), which also spreads a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.functions.columns import (
    exact_avg,
    exact_sum,
    is_pain_specialty,
    null_ratio,
    sum_if,
)
from scriptwell.operators.ranking import banded_rank_desc, first_per_key, rank_desc

DRUG_KEY = ["gnrc_name", "brnd_name", "year"]
PRESCRIBER_KEY = ["prscrbr_npi", "year"]
STATE_KEY = ["state_abrvtn", "year"]
PRESCRIBER_COLUMNS = [
    "prscrbr_npi", "prscrbr_last_org_name", "prscrbr_first_name",
    "prscrbr_state_abrvtn", "prscrbr_type", "prscrbr_city",
]

Stage = Callable[[DataFrame], DataFrame]


def _totals():
    return [
        F.sum("tot_clms").alias("total_claims"),
        exact_sum("tot_drug_cst").alias("total_cost_usd"),
        F.sum("tot_benes").alias("total_beneficiaries"),
    ]


def gold_stamp(df: DataFrame, name: str = "_gold_ts") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def _ranked(df: DataFrame, groups: list[str], name: str, stage: Stage | None) -> DataFrame:
    """Rank by cost within groups: over a plain window, or, when the rows can be stored
    first, in bands that keep any group from landing in one task."""
    if stage is None:
        return rank_desc(df, groups, "total_cost_usd", name)
    return banded_rank_desc(stage(df), groups, "total_cost_usd", name)


def drug_summary(silver: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Yearly totals per drug with the rank of its cost within the year."""
    by_drug = silver.groupBy(*DRUG_KEY, "is_generic").agg(
        *_totals(),
        exact_avg("avg_cost_per_claim").alias("avg_cost_per_claim"),
        F.count_distinct("prscrbr_npi").alias("unique_prescribers"),
    )
    return _ranked(by_drug, ["year"], "cost_rank", stage)


def prescriber_totals(silver: DataFrame) -> DataFrame:
    return silver.groupBy(*PRESCRIBER_KEY).agg(
        *_totals(),
        F.count_distinct("gnrc_name").alias("unique_drugs_prescribed"),
        sum_if(F.col("is_generic"), "tot_clms").alias("generic_claims"),
    )


def prescriber_summary(silver: DataFrame, prescribers: DataFrame, how: str = "left",
                       stage: Stage | None = None) -> DataFrame:
    """Yearly totals per prescriber with their profile and rank within the state.

    `stage` stores the unranked rows, so that ranking neither aggregates the claims a second
    time nor sorts a state with a large share of the prescribers in one task.
    """
    unranked = (
        prescriber_totals(silver)
        .join(prescribers.select(*PRESCRIBER_COLUMNS), "prscrbr_npi", how)
        .withColumn("generic_rate", null_ratio("generic_claims", "total_claims", factor=100))
    )
    return _ranked(unranked, ["prscrbr_state_abrvtn", "year"], "state_rank", stage)


def state_kpi(silver: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Yearly totals per state; a state reference adds its columns without adding rows.

    States are two-letter codes, so a year has few rows to rank.
    """
    by_state = silver.groupBy("prscrbr_state_abrvtn", "year").agg(
        *_totals(),
        F.count_distinct("prscrbr_npi").alias("total_prescribers"),
        F.count_distinct("gnrc_name").alias("unique_drugs"),
        exact_avg("avg_cost_per_claim").alias("avg_cost_per_claim"),
        sum_if(is_pain_specialty("prscrbr_type"), "tot_clms").alias("pain_specialty_claims"),
    )
    if states is None:
        joined = by_state.withColumnRenamed("prscrbr_state_abrvtn", "state_abrvtn")
    else:
        one_per_state = first_per_key(states, ["state_abrvtn"])
        joined = by_state.join(
            one_per_state,
            by_state["prscrbr_state_abrvtn"] == one_per_state["state_abrvtn"], "left")
    rated = joined.withColumn(
        "cost_per_beneficiary", null_ratio("total_cost_usd", "total_beneficiaries"))
    return rank_desc(rated, ["year"], "total_cost_usd", "national_rank")


def ranked_drug_sql(classified_view: str) -> str:
    """The drug table as one statement that ranks over its own aggregate."""
    return f"""
        SELECT generic_name, brand_name, claim_year, is_generic,
               CAST(SUM(total_claims) AS BIGINT) AS total_claims,
               CAST(SUM(CAST(total_cost_usd AS DECIMAL(38,12))) AS DOUBLE) AS total_cost_usd,
               CAST(SUM(total_beneficiaries) AS BIGINT) AS total_beneficiaries,
               COUNT(DISTINCT prescriber_npi) AS unique_prescribers,
               RANK() OVER (PARTITION BY claim_year
                            ORDER BY SUM(CAST(total_cost_usd AS DECIMAL(38,12))) DESC) AS cost_rank
        FROM {classified_view}
        GROUP BY generic_name, brand_name, claim_year, is_generic
    """
