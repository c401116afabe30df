import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptwell.operators import gold, ranking
from scriptwell.sources.workspace import write_once

PEOPLE = ("prscrbr_npi long, prscrbr_last_org_name string, prscrbr_first_name string, "
          "prscrbr_state_abrvtn string, prscrbr_type string, prscrbr_city string")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(31, "A", "A", "GA", "Dermatology", "GA CITY"),
                                  (32, "B", "B", "GA", "Anesthesiology", "GA CITY")], PEOPLE)


def test_drugs_by_year_with_ties(silver):
    rows = {(r.brnd_name, r.year): r for r in gold.drug_summary(silver).collect()}
    allegra = rows["ALLEGRA", 2020]
    assert (allegra.total_claims, allegra.total_cost_usd, allegra.unique_prescribers) == (20, 105.0, 2)
    assert {k: r.cost_rank for k, r in rows.items()} == {
        ("ALLEGRA", 2020): 1, ("CETIRIZINE", 2020): 2, ("CETIRIZINE", 2021): 1, ("ULTRAM", 2021): 1,
        ("ZYRTEC", 2021): 3}


def test_states_by_year_with_ties_and_pain_claims(silver):
    rows = {(r.state_abrvtn, r.year): r for r in gold.state_kpi(silver).collect()}
    assert {k: (r.total_cost_usd, r.cost_per_beneficiary, r.pain_specialty_claims, r.national_rank)
            for k, r in rows.items()} == {
        ("GA", 2020): (150.0, 15.0, 8, 1), ("GA", 2021): (20.0, 4.0, 10, 1),
        ("ME", 2021): (20.0, 10.0, 0, 1)}


def test_claims_without_a_state_are_a_state_of_their_own(silver):
    lost = silver.filter("prscrbr_npi = 34").withColumn(
        "prscrbr_state_abrvtn", F.lit(None).cast("string"))
    rows = {(r.state_abrvtn, r.year): r for r in gold.state_kpi(silver.unionByName(lost)).collect()}
    assert rows[None, 2021].total_claims == 4 and rows["ME", 2021].total_claims == 4
    assert rows[None, 2021].national_rank == 1


def test_zero_denominators_give_null(silver, people):
    nobody = silver.filter("tot_benes = 0 AND tot_clms = 0")
    assert gold.state_kpi(nobody).filter("cost_per_beneficiary IS NOT NULL").count() == 0
    assert gold.prescriber_summary(nobody, people).filter("generic_rate IS NOT NULL").count() == 0


def test_left_and_inner_join(silver, people):
    left = {(r.prscrbr_npi, r.year): r for r in gold.prescriber_summary(silver, people).collect()}
    inner = gold.prescriber_summary(silver, people, "inner").collect()
    assert {(r.prscrbr_npi, r.year) for r in inner} == set(left) - {(34, 2021)}
    assert left[34, 2021].prscrbr_state_abrvtn is None
    assert {k: (r.generic_rate, r.state_rank) for k, r in left.items()} == {
        (31, 2020): (71.43, 1), (32, 2020): (0.0, 2), (32, 2021): (100.0, 1), (34, 2021): (0.0, 1)}


def test_staged_summary_is_the_same(silver, people):
    staged = gold.prescriber_summary(silver, people, stage=lambda d: write_once(d, "t"))
    plain = gold.prescriber_summary(silver, people)
    assert sorted(map(str, staged.collect())) == sorted(map(str, plain.collect()))


def test_state_reference_adds_no_rows(spark, silver):
    states = spark.createDataFrame([("GA", "Georgia")] * 50 + [("ME", "Maine")],
                                   "state_abrvtn string, state_name string")
    joined = gold.state_kpi(silver, states)
    assert joined.count() == gold.state_kpi(silver).count()
    assert {r.state_name for r in joined.collect()} == {"Georgia", "Maine"}


def test_gold_never_has_more_rows_than_silver(silver):
    assert gold.drug_summary(silver).count() <= silver.count()


def test_sums_survive_aggregation(silver):
    total = silver.agg(F.sum("tot_drug_cst")).first()[0]
    assert gold.drug_summary(silver).agg(F.sum("total_cost_usd")).first()[0] == total


def test_banded_rank_equals_window_rank(spark):
    random.seed(7)
    values = [0.0, 0.0, None, -3.5, 1e15, 0.01] + [
        round(random.choice([1, 1e3, 1e7]) * random.random(), 2) for _ in range(1500)]
    rows = [(random.choice(["HOT", "HOT", "TX", None]), random.choice([2022, 2023]), v)
            for v in values + [42.0] * 500]
    df = spark.createDataFrame(rows, "state string, year int, cost double").repartition(4)
    plain = df.withColumn("expected", F.rank().over(
        Window.partitionBy("state", "year").orderBy(F.desc("cost"))))
    got = ranking.banded_rank_desc(plain, ["state", "year"], "cost", "rank")
    assert got.count() == len(rows)
    assert got.filter("rank <> expected OR rank IS NULL").count() == 0


def test_quantiles_equal_sorting(spark):
    random.seed(11)
    rows = [(random.choice(["a", "a", None]), random.choice([None, 5.0, random.randint(-90, 90) / 7,
                                                             random.random() * 1e6]))
            for _ in range(900)] + [("one", 3.25)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.lo, r.mid, r.hi) for r in ranking.quantiles(
        df, ["g"], "v", {"lo": "0", "mid": "0.5", "hi": "0.99"}).collect()}
    for g in ("a", None, "one"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        n = len(v)
        assert got[g] == (v[0], v[-(-n // 2) - 1], v[-(-99 * n // 100) - 1])


def test_bands_keep_order(spark):
    from scriptwell.functions.columns import amount_band
    df = spark.range(0, 200_000, 7).select((F.col("id") * F.col("id") / 100).alias("c"))
    lag = F.lag("b").over(Window.orderBy("c"))
    assert df.withColumn("b", amount_band("c")).withColumn("p", lag).filter("b < p").count() == 0


def test_rank_over_aggregate_in_sql(spark, silver):
    from scriptwell.operators import staging
    staging.classify_claims(staging.stg_prescriber_drug(
        silver.withColumn("_silver_ts", F.current_timestamp()))).createOrReplaceTempView("cc")
    ranks = sorted((r.claim_year, r.cost_rank) for r in spark.sql(gold.ranked_drug_sql("cc")).collect())
    assert ranks == [(2020, 1), (2020, 2), (2021, 1), (2021, 1), (2021, 3)]


def test_sums_keep_small_and_large_values(spark):
    from scriptwell.functions.columns import exact_avg, exact_sum
    rows = spark.createDataFrame([(0.004, 1e17)] * 1000, "a double, b double").repartition(3)
    small, mean, large = rows.agg(exact_sum("a"), exact_avg("a"), exact_sum("b")).first()
    assert (small, mean, large) == (4.0, 0.004, 1e20)
