"""Sentences and report lines filled from small ranked results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptwell.fixed_values import (
    ANSWER_FORMATS,
    DUPLICATE_KEYS_FORMAT,
    INSIGHT_FORMATS,
    NO_DATA_TEXT,
    OUTLIER_FORMAT,
    RECOMMENDATION_FORMATS,
    REPORT_SECTIONS,
    SUMMARY_FORMAT,
)
from scriptwell.functions.columns import exact_sum, optional_eq
from scriptwell.operators import findings, serving
from scriptwell.operators.ranking import top_per_group


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds 1, 2, … to a result of a few rows."""
    gathered = df.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct("*").alias("row"))))
                      .alias("rows"))
    return gathered.select(F.posexplode("rows").alias("no", "r")).select(
        (F.col("no") + 1).alias("no"), "r.row.*")


def _by_cost(df: DataFrame, *ties: str) -> DataFrame:
    return _ranked(df, (-F.col("total_cost_usd")).alias("k"), *[F.col(t) for t in ties])


def _line(position: int, fmt: str, *values: Column) -> list[Column]:
    return [F.lit(position).alias("position"), F.format_string(fmt, *values).alias("text")]


def _millions(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / 1e6


def insights(gold: dict[str, DataFrame], year: int | None = None) -> DataFrame:
    """Bullets on the top two drugs, the top state and the mean generic rate."""
    drugs = _by_cost(serving.top_drugs(gold["drug_summary"], year, 5), "gnrc_name", "brnd_name")
    states = serving.top_states(gold["state_kpi"], year, 1)
    rate = serving.avg_generic_rate(gold["prescriber_summary"], year)
    formats = INSIGHT_FORMATS
    parts = [
        drugs.filter("no = 1").select(*_line(
            1, formats["top_drug"], F.col("gnrc_name"), _millions("total_cost_usd"),
            F.col("total_claims").cast("double") / 1e3)),
        drugs.filter("no = 2").select(*_line(
            2, formats["second_drug"], F.col("gnrc_name"), _millions("total_cost_usd"))),
        states.select(*_line(
            3, formats["top_state"], F.col("state_abrvtn"), _millions("total_cost_usd"),
            F.coalesce("cost_per_beneficiary", F.lit(0.0)))),
        rate.filter("avg_generic_rate > 0").select(*_line(
            4, formats["generic_rate"], F.col("avg_generic_rate"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def executive_summary(gold: dict[str, DataFrame], period: str, year: int) -> DataFrame:
    """One paragraph on totals, top drug and top state; no row for a year without claims."""
    totals = serving.kpi_totals(gold["state_kpi"], year)
    drug = serving.top_drugs(gold["drug_summary"], year, 1).select(
        "gnrc_name", F.col("total_cost_usd").alias("drug_cost"))
    state = serving.top_states(gold["state_kpi"], year, 1).select(
        "state_abrvtn", F.col("total_cost_usd").alias("state_cost"))
    facts = totals.unionByName(drug, allowMissingColumns=True).unionByName(
        state, allowMissingColumns=True)
    row = facts.agg(*[F.max(c).alias(c) for c in facts.columns]).filter("total_spend > 0")
    return row.select(F.format_string(
        SUMMARY_FORMAT, F.lit(period), F.col("total_spend") / 1e9,
        F.col("total_benes").cast("double") / 1e6, F.col("gnrc_name"), _millions("drug_cost"),
        F.col("state_abrvtn"), _millions("state_cost")).alias("text"))


def quality_explanation(gold: dict[str, DataFrame], year: int, threshold: float) -> DataFrame:
    """Sentences on the strongest outlier and on duplicate keys, as far as there are any."""
    outlier = findings.zscore_outliers(gold["state_kpi"], year, threshold).limit(1).select(*_line(
        1, OUTLIER_FORMAT, F.col("state_abrvtn"), F.col("z_score").cast("string"),
        _millions("total_cost_usd")))
    duplicates = findings.gold_duplicates(gold).agg(
        F.sum("duplicate_key_groups").alias("n")).filter("n > 0").select(*_line(
            2, DUPLICATE_KEYS_FORMAT, F.col("n")))
    return outlier.unionByName(duplicates)


def recommendations(gold: dict[str, DataFrame], year: int) -> DataFrame:
    """Prioritised advice from the two best swaps and the lowest generic rate."""
    swaps = _ranked(findings.savings_candidates(gold["drug_summary"], year),
                    (-F.col("potential_savings")).alias("k"), F.col("gnrc_name"),
                    F.col("brnd_name"))
    low = _ranked(findings.low_adoption_states(gold["prescriber_summary"], year),
                  F.col("state_generic_rate"), F.col("prscrbr_state_abrvtn")).filter("no = 1")
    f = RECOMMENDATION_FORMATS

    def advice(position, text, impact, priority):
        return [F.lit(position).alias("position"), text.alias("recommendation"),
                impact.alias("estimated_impact"), F.lit(priority).alias("priority")]

    swap = swaps.filter("no <= 2").select(
        "no",
        F.when(F.col("no") == 1, F.format_string(
            f["first_swap"], F.col("gnrc_name"), F.col("brnd_name")))
        .otherwise(F.format_string(
            f["second_swap"], F.col("gnrc_name"), F.col("brnd_name"))).alias("text"),
        F.when(F.col("no") == 1, F.format_string(f["first_swap_impact"], F.col("potential_savings")))
        .otherwise(F.format_string(f["second_swap_impact"], F.col("potential_savings")))
        .alias("impact"))
    swap_rows = swap.select(F.col("no").alias("position"), F.col("text").alias("recommendation"),
                            F.col("impact").alias("estimated_impact"),
                            F.lit("high").alias("priority"))
    low_row = low.select(*advice(
        3, F.format_string(f["low_adoption"], F.col("prscrbr_state_abrvtn"),
                           F.col("state_generic_rate")),
        F.lit(None).cast("string"), "medium"))
    return swap_rows.unionByName(low_row)


# Per canned query: Gold table, columns of the sentence, measure that puts a row first, ties.
_ANSWERS = {
    "top_state": ("state_kpi", ("state_abrvtn", "total_cost_usd", "total_beneficiaries"),
                  "total_cost_usd", ("state_abrvtn",)),
    "top_drugs": ("drug_summary", ("gnrc_name", "brnd_name", "total_cost_usd", "total_claims"),
                  "total_cost_usd", ("gnrc_name", "brnd_name")),
    "top_prescribers": (
        "prescriber_summary",
        ("prscrbr_last_org_name", "prscrbr_state_abrvtn", "total_cost_usd", "generic_rate"),
        "total_cost_usd", ("prscrbr_npi",)),
    "opioid_by_state": ("state_kpi", ("state_abrvtn", "pain_specialty_claims", "total_claims"),
                        "pain_specialty_claims", ("state_abrvtn",)),
    "avg_cost": ("state_kpi", ("state_abrvtn", "avg_cost_per_claim", "cost_per_beneficiary"),
                 "avg_cost_per_claim", ("state_abrvtn",)),
}


def answers(gold: dict[str, DataFrame], year: int | None = None) -> DataFrame:
    """The sentence behind each canned query, for one year or for every year."""
    parts = []
    for key, (table, columns, measure, ties) in _ANSWERS.items():
        first = top_per_group(optional_eq(gold[table], "year", year), ["year"],
                              [F.desc(measure), *[F.asc(t) for t in ties]], 1)
        text = F.format_string(ANSWER_FORMATS[key], *[F.col(c) for c in columns])
        parts.append(first.select(F.lit(key).alias("query"), "year", text.alias("text")))
    spend = optional_eq(gold["drug_summary"], "year", year).groupBy("year", "is_generic").agg(
        exact_sum("total_cost_usd").alias("cost"), F.sum("total_claims").alias("claims"))
    by_flag = F.format_string(
        ANSWER_FORMATS["generic_vs_brand"],
        F.when(F.col("is_generic"), "Generic").otherwise("Brand"), F.col("cost"), F.col("claims"))
    both = spend.groupBy("year").agg(
        F.array_join(F.sort_array(F.collect_list(by_flag)), "; ").alias("text"))
    parts.append(both.select(F.lit("generic_vs_brand").alias("query"), "year", "text"))
    return reduce(DataFrame.unionByName, parts)


def answer_questions(routed: DataFrame, sentences: DataFrame) -> DataFrame:
    """Adds the answer to each routed question; no answer without a recognised intent."""
    found = sentences.withColumnRenamed("query", "intent").withColumnRenamed("text", "answer")
    unknown_year = F.when(F.col("intent").isNotNull(), F.lit(NO_DATA_TEXT))
    return routed.join(found, ["intent", "year"], "left").withColumn(
        "answer", F.coalesce("answer", unknown_year))


def report_lines(gold: dict[str, DataFrame], year: int) -> DataFrame:
    """Numbered Markdown lines of the three top-10 tables."""
    tables = {
        "drugs": (_by_cost(serving.top_drugs(gold["drug_summary"], year), "gnrc_name",
                           "brnd_name"),
                  ("gnrc_name", "total_cost_usd", "total_claims", "unique_prescribers")),
        "states": (_by_cost(serving.top_states(gold["state_kpi"], year, 10), "state_abrvtn"),
                   ("state_abrvtn", "total_cost_usd", "total_beneficiaries",
                    "cost_per_beneficiary")),
        "prescribers": (_by_cost(serving.top_prescribers(gold["prescriber_summary"], year),
                                 "prscrbr_npi"),
                        ("prscrbr_last_org_name", "prscrbr_state_abrvtn", "total_cost_usd",
                         "generic_rate")),
    }
    parts = []
    for section, (name, (rows, columns)) in enumerate(tables.items(), start=1):
        title, header, rule, fmt = REPORT_SECTIONS[name]
        body = rows.select(
            F.lit(section).alias("section"), (F.col("no") + 2).alias("line_no"),
            F.format_string(fmt, *[F.col(c) for c in columns]).alias("line"))
        heads = rows.sparkSession.createDataFrame(
            [(section, i, text) for i, text in enumerate((title, header, rule))],
            "section int, line_no int, line string")
        parts += [heads, body]
    return reduce(DataFrame.unionByName, parts)


def report_dates(now: Column, period: str) -> tuple[Column, Column]:
    """Start and end day of a weekly or monthly period."""
    days = 7 if period == "weekly" else 30
    end = now.cast("date")
    return F.date_sub(end, days), end

