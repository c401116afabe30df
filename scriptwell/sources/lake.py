"""Layered Parquet storage: `{root}/{layer}/{table}/date={date}`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptwell.fixed_values import BRONZE_LAYOUT, SPLIT_READ_ABOVE
from scriptwell.operators.cleaning import restamp
from scriptwell.schemas import LAYERS
from scriptwell.sources.jdbc import read_jdbc, read_jdbc_partitioned

SILVER_LAYOUT = {"prescriber_drug": ["year", "prscrbr_state_abrvtn"]}
GOLD_LAYOUT = {"prescriber_summary": ["year", "prscrbr_state_abrvtn"], "state_kpi": ["year"],
               "drug_summary": []}


class BrokenContract(ValueError):
    """Stored columns whose type is not the declared one, by name."""


def layer_path(root: str, layer: str, table: str, date: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{table}/date={date}"


def contract_of(found: StructType, declared: StructType) -> list[tuple[str, str, str, str]]:
    """(column, declared type, stored type, verdict) of every column on either side, in order of
    name; "wrong type" refuses a read, "absent" columns are read as null, "extra" ones are left."""
    want = {f.name: f.dataType.simpleString() for f in declared}
    have = {f.name: f.dataType.simpleString() for f in found}

    def verdict(name: str) -> str:
        if name not in want:
            return "extra"
        if name not in have:
            return "absent"
        return "ok" if want[name] == have[name] else "wrong type"

    return [(name, want.get(name, ""), have.get(name, ""), verdict(name))
            for name in sorted({*want, *have})]


def layer_contract(spark: SparkSession, root: str, layer: str, table: str, date: str) -> DataFrame:
    """What `contract_of` says about a stored layer, from the types in its files and folders."""
    found = spark.read.parquet(layer_path(root, layer, table, date)).schema
    rows = [(layer, table, *row) for row in contract_of(found, LAYERS[layer, table])]
    return spark.createDataFrame(rows, "layer string, table string, column string, declared string, "
                                       "stored string, verdict string")


def read_layer(spark: SparkSession, root: str, layer: str, table: str, date: str,
               schema: StructType | None = None) -> DataFrame:
    """A stored layer under its declared schema.

    A stored column of another type stops the read before any row is read. Types are compared,
    not cast: a reader told to expect another type would fail inside tasks or give nulls.
    """
    path = layer_path(root, layer, table, date)
    declared = schema or LAYERS.get((layer, table))
    if declared is None:
        return spark.read.parquet(path)
    found = spark.read.parquet(path).schema
    wrong = [f"{name}: declared {want}, stored {have}"
             for name, want, have, verdict in contract_of(found, declared) if verdict == "wrong type"]
    if wrong:
        raise BrokenContract(f"{layer}.{table}: {'; '.join(wrong)}")
    return spark.read.schema(declared).parquet(path)


def stamp_ingestion(df: DataFrame, date: str, table: str) -> DataFrame:
    return df.withColumns({
        "_ingestion_date": F.lit(date),
        "_ingestion_ts": F.current_timestamp(),
        "_source_table": F.lit(table),
    })


def write_counted(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> int:
    """Overwrite a Parquet path and return the row count observed during that write.

    Rows of one folder are brought together first, so that a folder gets few files whatever the
    number of tasks. Rebalancing goes by measured sizes: small folders share a task, a folder that
    holds much of the table is split over several.
    """
    seen = Observation()
    columns = [c for c in partition_by if c in df.columns]
    if columns:
        df = df.hint("rebalance", *[F.col(c) for c in columns])
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if columns:
        writer = writer.partitionBy(*columns)
    writer.parquet(path)
    return seen.get["rows"]


def write_bronze(df: DataFrame, root: str, table: str, date: str) -> dict:
    column, _ = BRONZE_LAYOUT.get(table, (None, 1))
    path = layer_path(root, "bronze", table, date)
    rows = write_counted(stamp_ingestion(df, date, table), path, [column] if column else [])
    return {"table": table, "rows": rows, "path": path}


def ingest_table(spark: SparkSession, table: str, jdbc_url: str, date: str, pg_props: dict,
                 root: str, split_column: str = "prscrbr_npi") -> dict:
    """Copy one source table to Bronze, reading large tables in parallel ranges."""
    _, splits = BRONZE_LAYOUT[table]
    if splits > SPLIT_READ_ABOVE:
        df = read_jdbc_partitioned(spark, jdbc_url, table, split_column, n=splits, props=pg_props)
    else:
        df = read_jdbc(spark, jdbc_url, table, pg_props)
    return write_bronze(df, root, table, date)


def write_silver(df: DataFrame, root: str, table: str, date: str) -> int:
    return write_counted(df, layer_path(root, "silver", table, date),
                         SILVER_LAYOUT.get(table, []))


def write_gold(df: DataFrame, root: str, table: str, date: str) -> int:
    return write_counted(df, layer_path(root, "gold", table, date), GOLD_LAYOUT.get(table, []))


def ingestion_summary(spark: SparkSession, results: list[dict]) -> DataFrame:
    """One row per written table and a TOTAL row; the input is one entry per table."""
    written = spark.createDataFrame([Row(**r) for r in results],
                                    "table string, rows long, path string")
    return with_total(written.select("table", "rows"))


def with_total(counts: DataFrame) -> DataFrame:
    return (
        counts.rollup("table").agg(F.sum("rows").alias("rows"))
        .withColumn("table", F.coalesce("table", F.lit("TOTAL")))
    )
