"""Bronze to Silver: normalise, filter, deduplicate, derive, restamp."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptwell.functions.columns import initcap_trim, is_generic, safe_ratio, upper_trim
from scriptwell.operators.ranking import first_per_key
from scriptwell.schemas import BRONZE_STAMP

SILVER_VERSION = "1.0"
CLAIM_KEY = ["prscrbr_npi", "brnd_name", "year"]


def drop_stamp(df: DataFrame) -> DataFrame:
    return df.drop(*BRONZE_STAMP.fieldNames())


def restamp(df: DataFrame, stamp: str = "_silver_ts", version: str | None = None) -> DataFrame:
    stamped = drop_stamp(df).withColumn(stamp, F.current_timestamp())
    return stamped if version is None else stamped.withColumn("_silver_version", F.lit(version))


def normalize_claims(df: DataFrame) -> DataFrame:
    filled = df.fillna({"tot_clms": 0, "tot_drug_cst": 0.0, "tot_benes": 0})
    return filled.withColumns({
        "prscrbr_state_abrvtn": upper_trim("prscrbr_state_abrvtn"),
        "gnrc_name": upper_trim("gnrc_name"),
        "brnd_name": upper_trim("brnd_name"),
        "prscrbr_type": initcap_trim("prscrbr_type"),
    })


def valid_claims(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("prscrbr_npi").isNotNull()
        & (F.col("tot_clms") >= 0)
        & (F.col("tot_drug_cst") >= 0)
        & (F.length("prscrbr_state_abrvtn") == 2)
    )


def dedup_claims(df: DataFrame, tie_break: list[Column] | None = None) -> DataFrame:
    """One row per business key, after normalisation so that spellings meet."""
    return first_per_key(drop_stamp(df), CLAIM_KEY, tie_break)


def clean_prescriber_drug(df: DataFrame, tie_break: list[Column] | None = None) -> DataFrame:
    unique = dedup_claims(valid_claims(normalize_claims(df)), tie_break)
    derived = unique.withColumns({
        "avg_cost_per_claim": safe_ratio("tot_drug_cst", "tot_clms"),
        "is_generic": is_generic("brnd_name", "gnrc_name"),
    })
    return restamp(derived, version=SILVER_VERSION)


def clean_prescriber(df: DataFrame) -> DataFrame:
    filled = (
        drop_stamp(df)
        .fillna({"prscrbr_type": "Unknown", "prscrbr_city": "Unknown"})
        .withColumn("prscrbr_state_abrvtn", upper_trim("prscrbr_state_abrvtn"))
        .filter(F.col("prscrbr_npi").isNotNull())
    )
    return restamp(first_per_key(filled, ["prscrbr_npi"]))


def clean_drug(df: DataFrame) -> DataFrame:
    named = drop_stamp(df).withColumns({
        "gnrc_name": upper_trim("gnrc_name"), "brnd_name": upper_trim("brnd_name"),
    })
    return restamp(first_per_key(named, ["gnrc_name"]))


def clean_state(df: DataFrame) -> DataFrame:
    return restamp(df)


# Cleaner per Bronze table; add an entry to clean a further table.
CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "prescriber_drug": clean_prescriber_drug,
    "prescriber": clean_prescriber,
    "drug": clean_drug,
    "state": clean_state,
}


def union_landing(bulk: DataFrame, streamed: DataFrame) -> DataFrame:
    """Nightly bulk rows plus streamed rows; `dedup_claims` later removes repeats."""
    return bulk.unionByName(streamed, allowMissingColumns=True)


def event_claims(landed: DataFrame) -> DataFrame:
    """Landed claim events as bulk rows: one claim each. What events don't tell stays out, and
    `union_landing` leaves it null."""
    return landed.select(
        "prscrbr_npi", "prscrbr_state_abrvtn", "brnd_name", "gnrc_name",
        F.lit(1).alias("tot_clms"), F.col("drug_cost_usd").alias("tot_drug_cst"),
        F.year("event_time").alias("year"))
