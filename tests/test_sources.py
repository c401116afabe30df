import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from scriptwell import schemas
from scriptwell.operators import gold
from scriptwell.plans import layers, testdata
from scriptwell.session import shared_folder
from scriptwell.sources import catalog, jdbc, lake, reports
from scriptwell.sources.workspace import StoredTables, application_folder, write_once

SF = "/root/testdata/sf0.001"


class FakeReader:
    """Stands in for `spark.read`: records calls and answers from given frames."""

    def __init__(self, frames):
        self.frames, self.calls = frames, []

    def jdbc(self, url, table, **options):
        self.calls.append((table, options))
        return self.frames["bounds" if "MIN(" in table else table]


class FakeSession:
    def __init__(self, frames):
        self.read = FakeReader(frames)


def test_jdbc_full_scan(spark):
    session = FakeSession({"drug": spark.range(3)})
    assert jdbc.read_jdbc(session, "url", "drug", {"user": "u"}).count() == 3
    assert session.read.calls == [
        ("drug", {"properties": {"fetchsize": "10000", "user": "u"}})]


def test_jdbc_bounds_come_from_the_data(spark):
    bounds = spark.createDataFrame([(1_000_000_001, 9_999_999_999)], "lo long, hi long")
    session = FakeSession({"t": spark.range(3), "bounds": bounds})
    jdbc.read_jdbc_partitioned(session, "url", "t", "npi", n=200)
    _, options = session.read.calls[-1]
    assert (options["lowerBound"], options["upperBound"]) == (1_000_000_001, 10_000_000_000)
    assert options["numPartitions"] == 200 and options["column"] == "npi"


def test_jdbc_empty_table_is_read_unsplit(spark):
    bounds = spark.createDataFrame([(None, None)], "lo long, hi long")
    session = FakeSession({"t": spark.range(0), "bounds": bounds})
    jdbc.read_jdbc_partitioned(session, "url", "t", "npi")
    assert "numPartitions" not in session.read.calls[-1][1]


def test_ingest_splits_large_tables_only(spark, folder):
    data = spark.createDataFrame([(1, 2022), (2, 2023)], "prscrbr_npi long, year int")
    bounds = spark.createDataFrame([(1, 2)], "lo long, hi long")
    session = FakeSession({"prescriber_drug": data, "drug": data, "bounds": bounds})
    big = lake.ingest_table(session, "prescriber_drug", "url", "2024-01-01", {}, folder)
    small = lake.ingest_table(session, "drug", "url", "2024-01-01", {}, folder)
    assert big["rows"] == small["rows"] == 2
    stored = lake.read_layer(spark, folder, "bronze", "prescriber_drug", "2024-01-01")
    assert set(schemas.BRONZE_STAMP.fieldNames()) <= set(stored.columns)
    assert stored.filter("year = 2022").count() == 1 and "year=2022" in stored.inputFiles()[0] + \
        stored.inputFiles()[1]
    rows = {r.table: r.rows for r in lake.ingestion_summary(spark, [big, small]).collect()}
    assert rows == {"prescriber_drug": 2, "drug": 2, "TOTAL": 4}


def test_layers_from_bronze_to_gold(spark, folder):
    counts = {"bronze": {
        name: lake.write_bronze(df, folder, name, "d")["rows"]
        for name, df in layers.bronze(spark, SF).items()}}
    counts["silver"] = layers.build_silver(spark, folder, "d")
    counts["gold"] = layers.build_gold(spark, folder, "d")
    assert counts["silver"]["prescriber_drug"] <= counts["bronze"]["prescriber_drug"]
    people = lake.read_layer(spark, folder, "gold", "prescriber_summary", "d")
    silver = lake.read_layer(spark, folder, "silver", "prescriber_drug", "d")
    assert people.agg(F.sum("total_claims")).first()[0] == silver.agg(F.sum("tot_clms")).first()[0]
    firsts = people.filter("state_rank = 1").select("prscrbr_state_abrvtn", "year").distinct()
    assert firsts.count() == people.select("prscrbr_state_abrvtn", "year").distinct().count()
    layers.record_lineage(spark, f"{folder}/lineage", counts)
    assert spark.read.parquet(f"{folder}/lineage").count() == 2 * (4 + 3)

    catalog.create_table(spark, "drug_summary_table", schemas.DRUG_SUMMARY)
    drugs = lake.read_layer(spark, folder, "gold", "drug_summary", "d")
    upper = drugs.select(*[F.col(c).alias(c.upper()) for c in reversed(drugs.columns)])
    catalog.load_by_name(upper, "drug_summary_table")
    loaded = spark.table("drug_summary_table")
    assert loaded.columns == schemas.DRUG_SUMMARY.fieldNames()
    assert loaded.count() == counts["gold"]["drug_summary"]
    with pytest.raises(ValueError, match="cost_rank"):
        catalog.load_by_name(drugs.drop("cost_rank"), "drug_summary_table")


def test_partitioned_gold_loads_with_its_partition_columns(spark, folder, silver):
    lake.write_gold(gold.gold_stamp(gold.state_kpi(silver)), folder, "state_kpi", "d")
    stored = lake.read_layer(spark, folder, "gold", "state_kpi", "d")
    loaded = catalog.match_by_name(stored, schemas.STATE_KPI)
    assert sorted(r.year for r in loaded.select("year").distinct().collect()) == [2020, 2021]


def test_read_with_schema(spark, folder, silver):
    lake.write_silver(silver, folder, "prescriber_drug", "d")
    read = lake.read_layer(spark, folder, "silver", "prescriber_drug", "d",
                           schemas.SILVER_PRESCRIBER_DRUG)
    assert read.count() == 6 and read.filter("tot_30day_fills IS NOT NULL").count() == 0


def test_wrong_typed_columns_are_refused_by_name(spark, folder):
    bad = testdata.claims(spark, SF).withColumns({
        "tot_clms": F.col("tot_clms").cast("string"), "note": F.lit("x")}).drop("tot_day_suply")
    lake.write_bronze(bad, folder, "prescriber_drug", "d")
    with pytest.raises(lake.BrokenContract, match="tot_clms: declared int, stored string"):
        lake.read_layer(spark, folder, "bronze", "prescriber_drug", "d")
    with pytest.raises(lake.BrokenContract):
        layers.build_silver(spark, folder, "d")
    verdicts = {r.column: r.verdict for r in lake.layer_contract(
        spark, folder, "bronze", "prescriber_drug", "d").collect()}
    assert {k: v for k, v in verdicts.items() if v != "ok"} == {
        "tot_clms": "wrong type", "note": "extra", "tot_day_suply": "absent"}
    good = bad.withColumn("tot_clms", F.col("tot_clms").cast("int"))
    lake.write_bronze(good, folder, "prescriber_drug", "e")
    read = lake.read_layer(spark, folder, "bronze", "prescriber_drug", "e")
    assert "note" not in read.columns and read.filter("tot_day_suply IS NOT NULL").count() == 0


def test_folders_get_few_files(spark, folder):
    """Rows of one folder come from many tasks and end in few files; all of them, null folder too."""
    df = spark.range(0, 20_000, 1, 40).select(
        (F.col("id") % 3 + 2020).cast("int").alias("year"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("S"), F.col("id") % 7)).alias("state"), "id")
    assert lake.write_counted(df, f"{folder}/t", ["year", "state"]) == 20_000
    stored = spark.read.parquet(f"{folder}/t")
    assert stored.count() == 20_000 and stored.filter("state IS NULL").count() == 2858
    files = stored.select("year", "state", F.input_file_name().alias("f")).distinct() \
        .groupBy("year", "state").count()
    assert files.count() == 21 and files.filter("count > 2").count() == 0


def test_clustered_table_skips_files(spark):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    name = f"clustered_{os.getpid()}"
    table = catalog.materialize(df, name, "table", "k")
    spread = table.groupBy(F.input_file_name()).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    ranges = sorted((r.lo, r.hi) for r in spread.collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    scan = table.filter("k = 5")
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,5)]" in \
        scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 40


def test_lineage_comes_from_the_writes(spark):
    """Counts of the stored events are those of the stored layers."""
    built = layers.built_lake(spark, SF).collect()
    rows = {f"lake/{r.layer}/{r.table}": r.rows for r in built}
    from scriptwell.operators import lineage
    events = spark.read.schema(schemas.LINEAGE_EVENT).parquet(f"{built[0].root}/lineage")
    assert events.count() == 2 * (4 + 3)
    up = {r.dataset: (r.distance, r.row_count)
          for r in lineage.upstream_rows(events, "lake/gold/state_kpi").collect()}
    assert up == {"lake/silver/prescriber_drug": (1, rows["lake/silver/prescriber_drug"]),
                  "lake/bronze/prescriber_drug": (2, rows["lake/bronze/prescriber_drug"])}


def test_materialize(spark, silver):
    assert catalog.materialize(silver, "m_inline", "ephemeral") is silver
    assert catalog.materialize(silver, "m_view", "view").count() == 6
    assert catalog.materialize(silver, "m_table", "table", "year").count() == 6
    assert spark.catalog.tableExists("m_table")
    with pytest.raises(ValueError):
        catalog.materialize(silver, "m", "cube")


def test_report_file(spark, folder):
    lines = spark.createDataFrame([(2, 0, "b"), (1, 1, "a1"), (1, 0, "a0")],
                                  "section int, line_no int, line string")
    reports.write_markdown(lines.repartition(3), f"{folder}/report")
    assert [r.value for r in spark.read.text(f"{folder}/report").collect()] == ["a0", "a1", "b"]


def test_write_once_uses_the_shared_folder(spark):
    stored = write_once(spark.range(5), "numbers")
    assert stored.count() == 5
    assert shared_folder(spark) in stored.inputFiles()[0]


def test_stored_tables_follow_their_source(spark, folder):
    source = f"{folder}/changing"
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        stored = StoredTables.get(spark, source, "ids", lambda: spark.read.parquet(source))
        assert stored.count() == spark.read.parquet(source).count()


def test_stored_tables_are_built_once(spark):
    builds = []

    def build():
        builds.append(1)
        return spark.range(3)

    for _ in range(2):
        stored = StoredTables.get(spark, "src/", "numbers", build)
    assert stored.count() == 3 and len(builds) == 1
    kept = dict(StoredTables._tables)
    other = spark.newSession()
    assert StoredTables.get(other, "src", "numbers", lambda: other.range(4)).count() == 4
    assert set(kept) < set(StoredTables._tables)
    assert spark.sparkContext.applicationId in application_folder(spark)


def test_task_code_needs_no_package_on_executors(folder):
    """Unpickle in a process that cannot import this package."""
    from pyspark.cloudpickle import dumps

    from scriptwell.functions.vectors import best_rows
    from scriptwell.streaming.tracker import TrailingCounter

    task = (best_rows(["q"], [[1.0, 0.0]], "id", "embedding", 2), TrailingCounter(60))
    with open(f"{folder}/task", "wb") as out:
        out.write(dumps(task))
    code = ("import pickle, sys; fn, counter = pickle.load(open('task', 'rb')); "
            "assert not [m for m in sys.modules if m.startswith('scriptwell')]; "
            "assert list(fn([])) == []")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, check=True)


def test_mapping_covers_every_line_item(spark):
    assert testdata.claims(spark, SF).count() == testdata.table(spark, SF, "lineitem").count()


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace as Stub
    unset = Stub(get=lambda key, default: default)
    cluster = Stub(conf=unset, sparkContext=Stub(master="spark://host:1", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)
    alone = Stub(conf=unset, sparkContext=Stub(master="local[2]", applicationId="a"))
    assert shared_folder(alone) == shared_folder(alone)
