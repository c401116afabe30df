"""Savings candidates, low generic adoption, spend outliers, duplicate keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.fixed_values import LOW_ADOPTION_FACTOR, OUTLIER_Z, SAVINGS_COST_FACTOR
from scriptwell.functions.columns import optional_eq
from scriptwell.operators.gold import DRUG_KEY, PRESCRIBER_KEY, STATE_KEY
from scriptwell.operators.ranking import top_per_group


def savings_pairs(drugs: DataFrame, year: int | None = None,
                  factor: float = SAVINGS_COST_FACTOR) -> DataFrame:
    """Brand rows against the generic of the same name and year that costs clearly less."""
    rows = optional_eq(drugs, "year", year)
    brand = rows.filter(~F.col("is_generic")).select(
        "gnrc_name", "year", "brnd_name", "total_claims",
        F.col("avg_cost_per_claim").alias("brand_cost"))
    generic = rows.filter("is_generic").select(
        "gnrc_name", "year", F.col("avg_cost_per_claim").alias("generic_cost"))
    dearer = brand.join(generic, ["gnrc_name", "year"]).filter(
        F.col("brand_cost") > F.col("generic_cost") * F.lit(factor))
    gap = (F.col("brand_cost") - F.col("generic_cost")) * F.col("total_claims")
    return dearer.select(
        "brnd_name", "gnrc_name", "year", "brand_cost", "generic_cost",
        F.round(gap, 0).alias("potential_savings"))


def savings_candidates(drugs: DataFrame, year: int | None = None, n: int = 10) -> DataFrame:
    """The n largest potential savings of each year."""
    order = [F.desc("potential_savings"), F.asc("gnrc_name"), F.asc("brnd_name")]
    return top_per_group(savings_pairs(drugs, year), ["year"], order, n)


def total_savings(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("year").agg(
        F.sum("potential_savings").alias("total_potential_savings"))


def vs_global(df: DataFrame, key: str, metric: str, factor: float,
              scope: list[str]) -> DataFrame:
    """Groups whose mean stays under factor times the mean over all groups.

    Groups are summed first; the overall mean is then a window over the few sums.
    """
    sums = df.groupBy(*scope, key).agg(
        F.sum(F.col(metric).cast("decimal(38,12)")).alias("__sum"),
        F.count(metric).alias("__n"))
    everyone = Window.partitionBy(*scope)
    means = sums.select(
        *scope, key,
        F.try_divide(F.col("__sum").cast("double"), F.col("__n").cast("double"))
        .alias("group_mean"),
        F.try_divide(F.sum("__sum").over(everyone).cast("double"),
                     F.sum("__n").over(everyone).cast("double")).alias("global_mean"))
    return means.filter(F.col("group_mean") < F.col("global_mean") * F.lit(factor))


def low_adoption_states(prescribers: DataFrame, year: int | None = None,
                        n: int = 8) -> DataFrame:
    """Per year the states furthest below the mean generic rate; missing rates are zero."""
    rows = optional_eq(prescribers, "year", year).select(
        "year", F.coalesce("prscrbr_state_abrvtn", F.lit("Unknown")).alias("state"),
        F.coalesce("generic_rate", F.lit(0.0)).alias("rate"))
    low = vs_global(rows, "state", "rate", LOW_ADOPTION_FACTOR, ["year"]).select(
        "year", F.col("state").alias("prscrbr_state_abrvtn"),
        F.round("group_mean", 1).alias("state_generic_rate"),
        F.round("global_mean", 1).alias("national_avg_rate"))
    order = [F.asc("state_generic_rate"), F.asc("prscrbr_state_abrvtn")]
    return top_per_group(low, ["year"], order, n)


def zscore_outliers(states: DataFrame, year: int | None = None,
                    threshold: float = OUTLIER_Z) -> DataFrame:
    """States whose yearly cost lies far from the mean, judged on the rounded z-score."""
    yearly = Window.partitionBy("year")
    cost = F.coalesce("total_cost_usd", F.lit(0.0))
    scored = optional_eq(states, "year", year).select(
        "state_abrvtn", "year", cost.alias("total_cost_usd"),
        F.coalesce("cost_per_beneficiary", F.lit(0.0)).alias("cost_per_beneficiary"),
    ).withColumns({
        "__mean": F.avg("total_cost_usd").over(yearly),
        "__std": F.stddev_samp("total_cost_usd").over(yearly),
        "__n": F.count(F.lit(1)).over(yearly),
    })
    z = F.round((F.col("total_cost_usd") - F.col("__mean")) / F.nullif("__std", F.lit(0.0)), 2)
    return (
        scored.filter((F.col("__n") >= 3) & (F.col("__std") > 0))
        .withColumn("z_score", z)
        .filter(F.abs("z_score") >= threshold)
        .drop("__mean", "__std", "__n")
        .orderBy(F.desc(F.abs("z_score")), "year", "state_abrvtn")
    )


GOLD_KEYS = {
    "drug_summary": DRUG_KEY,
    "prescriber_summary": PRESCRIBER_KEY,
    "state_kpi": STATE_KEY,
}


def duplicate_groups(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Number of key values that occur more than once, as one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") > 1).alias("duplicate_key_groups")).select(
        F.lit(table).alias("table"), "duplicate_key_groups")


def gold_duplicates(gold: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [duplicate_groups(gold[t], t, keys) for t, keys in GOLD_KEYS.items()])


def quality_status(gold: dict[str, DataFrame], threshold: float = OUTLIER_Z) -> DataFrame:
    """Issue counts and the combined verdict, one row."""
    outliers = zscore_outliers(gold["state_kpi"], threshold=threshold).agg(
        F.count(F.lit(1)).alias("issues")).select(F.lit("anomalies").alias("kind"), "issues")
    duplicates = gold_duplicates(gold).agg(
        F.sum("duplicate_key_groups").alias("issues")).select(
        F.lit("duplicates").alias("kind"), "issues")
    both = outliers.unionByName(duplicates)
    count = {k: F.sum(F.when(F.col("kind") == k, F.col("issues")).otherwise(0)).alias(k)
             for k in ("anomalies", "duplicates")}
    return both.agg(*count.values()).withColumn(
        "status", F.when(F.col("anomalies") + F.col("duplicates") > 0, "issues_found")
        .otherwise("healthy"))
