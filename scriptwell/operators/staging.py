"""Renamed and typed views over Silver, and the shared business classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.functions.columns import cost_tier, is_pain_specialty


def stg_prescriber_drug(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("prscrbr_npi").alias("prescriber_npi"),
        F.col("brnd_name").alias("brand_name"),
        F.col("gnrc_name").alias("generic_name"),
        F.col("prscrbr_state_abrvtn").alias("prescriber_state"),
        F.col("prscrbr_type").alias("prescriber_specialty"),
        F.col("year").alias("claim_year"),
        F.col("tot_clms").cast("decimal(18,0)").alias("total_claims"),
        F.col("tot_drug_cst").cast("double").alias("total_cost_usd"),
        F.col("tot_benes").cast("decimal(18,0)").alias("total_beneficiaries"),
        F.col("avg_cost_per_claim").cast("double").alias("avg_cost_per_claim"),
        "is_generic",
        F.col("_silver_ts").alias("silver_loaded_at"),
    )


PRESCRIBER_NAMES = {
    "prscrbr_npi": "prescriber_npi",
    "prscrbr_last_org_name": "prescriber_last_name",
    "prscrbr_first_name": "prescriber_first_name",
    "prscrbr_city": "prescriber_city",
    "prscrbr_state_abrvtn": "prescriber_state",
    "prscrbr_type": "prescriber_specialty",
    "_silver_ts": "silver_loaded_at",
}


def stg_prescriber(silver: DataFrame) -> DataFrame:
    return silver.withColumnsRenamed(PRESCRIBER_NAMES).select(*PRESCRIBER_NAMES.values())


def classify_claims(staged: DataFrame) -> DataFrame:
    return staged.withColumns({
        "is_pain_management_specialty": is_pain_specialty("prescriber_specialty"),
        "cost_tier": cost_tier("avg_cost_per_claim"),
    })
