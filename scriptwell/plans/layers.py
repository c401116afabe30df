"""Bronze, Silver and Gold as jobs over dated storage, and as stored tables of a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from scriptwell.operators import cleaning, gold, lineage
from scriptwell.plans import testdata
from scriptwell.sources import lake
from scriptwell.sources.workspace import StoredTables, fresh_path, write_once

GOLD_TABLES = ("drug_summary", "prescriber_summary", "state_kpi")


def _stage(label: str) -> gold.Stage:
    return lambda df: write_once(df, label)


# ---- dated storage -------------------------------------------------------------------

def build_silver(spark: SparkSession, root: str, date: str) -> dict[str, int]:
    """Clean every Bronze table that has a cleaner; returns rows written per table."""
    return {
        table: lake.write_silver(cleaner(lake.read_layer(spark, root, "bronze", table, date)),
                                 root, table, date)
        for table, cleaner in cleaning.CLEANERS.items()
    }


def build_drug_summary(spark: SparkSession, root: str, date: str) -> int:
    silver = lake.read_layer(spark, root, "silver", "prescriber_drug", date)
    ranked = gold.drug_summary(silver, stage=_stage("drug_unranked"))
    return lake.write_gold(gold.gold_stamp(ranked), root, "drug_summary", date)


def build_prescriber_summary(spark: SparkSession, root: str, date: str, how: str = "left") -> int:
    silver = lake.read_layer(spark, root, "silver", "prescriber_drug", date)
    people = lake.read_layer(spark, root, "silver", "prescriber", date)
    ranked = gold.prescriber_summary(silver, people, how, stage=_stage("prescriber_unranked"))
    return lake.write_gold(gold.gold_stamp(ranked), root, "prescriber_summary", date)


def build_state_kpi(spark: SparkSession, root: str, date: str) -> int:
    silver = lake.read_layer(spark, root, "silver", "prescriber_drug", date)
    states = lake.read_layer(spark, root, "silver", "state", date).drop("_silver_ts")
    return lake.write_gold(gold.gold_stamp(gold.state_kpi(silver, states)), root, "state_kpi", date)


def build_gold(spark: SparkSession, root: str, date: str) -> dict[str, int]:
    return {
        "drug_summary": build_drug_summary(spark, root, date),
        "prescriber_summary": build_prescriber_summary(spark, root, date),
        "state_kpi": build_state_kpi(spark, root, date),
    }


def build_all(spark: SparkSession, bronze_tables: dict[str, DataFrame], root: str,
              date: str) -> dict[str, dict[str, int]]:
    """All three layers from given Bronze tables; returns rows written per layer and table."""
    written = [lake.write_bronze(df, root, name, date) for name, df in bronze_tables.items()]
    return {
        "bronze": {w["table"]: w["rows"] for w in written},
        "silver": build_silver(spark, root, date),
        "gold": build_gold(spark, root, date),
    }


def record_lineage(spark: SparkSession, path: str, counts: dict[str, dict[str, int]],
                   root: str = "lake") -> None:
    """Append START and COMPLETE rows of all layer transitions of one run, in one write; counts are
    those observed while the layers were written."""
    moves = [(f"clean_{t}", "bronze", t, "silver", t) for t in counts["silver"]] + [
        (f"build_{t}", "silver", "prescriber_drug", "gold", t) for t in counts["gold"]]
    reduce(DataFrame.unionByName, [
        lineage.transition_events(spark, job, layer_in, table_in, layer_out, table_out,
                                  counts[layer_in][table_in], counts[layer_out][table_out],
                                  root=root)
        for job, layer_in, table_in, layer_out, table_out in moves]
    ).coalesce(1).write.mode("append").parquet(path)


def built_lake(spark: SparkSession, sf_dir: str, date: str = "2024-01-01") -> DataFrame:
    """root, layer, table, rows of a full build, once per application; the rows are those observed
    by the writes. The run's lineage lies under the root as well."""
    def build() -> DataFrame:
        root = fresh_path(spark, "lake")
        counts = build_all(spark, bronze(spark, sf_dir), root, date)
        record_lineage(spark, f"{root}/lineage", counts)
        return spark.createDataFrame(
            [(root, layer, table, rows) for layer, tables in counts.items()
             for table, rows in tables.items()],
            "root string, layer string, table string, rows long").coalesce(1)

    return StoredTables.get(spark, sf_dir, "built_lake", build)


# ---- stored tables of a session ------------------------------------------------------

def bronze_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims, written once per application so that the joins behind them run once."""
    return StoredTables.get(spark, sf_dir, "bronze_claims",
                            lambda: testdata.claims(spark, sf_dir))


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "prescriber_drug": bronze_claims(spark, sf_dir),
        "prescriber": testdata.prescribers(spark, sf_dir),
        "drug": testdata.drugs(spark, sf_dir),
        "state": testdata.states(spark, sf_dir),
    }


def silver_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean claims, written once per application because all Gold tables read them."""
    return StoredTables.get(
        spark, sf_dir, "silver_claims",
        lambda: cleaning.clean_prescriber_drug(bronze_claims(spark, sf_dir)), ["year"])


def silver_prescribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_prescriber(testdata.prescribers(spark, sf_dir))


def _gold_builders(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    def prescribers() -> DataFrame:
        return gold.prescriber_summary(
            silver_claims(spark, sf_dir), silver_prescribers(spark, sf_dir),
            stage=_stage("prescriber_unranked"))

    return {
        "drug_summary": lambda: gold.drug_summary(
            silver_claims(spark, sf_dir), stage=_stage("drug_unranked")),
        "prescriber_summary": prescribers,
        "state_kpi": lambda: gold.state_kpi(
            silver_claims(spark, sf_dir), testdata.states(spark, sf_dir)
        ).drop("prscrbr_state_abrvtn", "state_name"),
    }


def gold_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Gold table, written once per application because most reads start from it."""
    return StoredTables.get(spark, sf_dir, name, _gold_builders(spark, sf_dir)[name])


def gold_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: gold_table(spark, sf_dir, name) for name in GOLD_TABLES}
