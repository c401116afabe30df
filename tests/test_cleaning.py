from pyspark.sql import functions as F

from scriptwell.operators import cleaning, staging
from scriptwell.schemas import PRESCRIBER_DRUG
from pyspark.sql.types import StructField, StructType

# The declared schema with a nullable key, as raw rows may lack one.
RAW = StructType([StructField(f.name, f.dataType) for f in PRESCRIBER_DRUG])


def claim(npi=5310, state="ny", kind="nurse practitioner", brand="Zestril", generic="lisinopril",
          claims=40, cost=320.0, benes=16, year=2022, city="ALBANY"):
    return (npi, "NGUYEN", "KIM", city, state, kind, brand, generic, claims, 44.0, cost, 120,
            benes, year)


def clean(spark, *rows):
    return cleaning.clean_prescriber_drug(spark.createDataFrame(list(rows), RAW))


def test_cleaned_columns(spark):
    a, b, c = clean(
        spark, claim(city=None), claim(city=None),
        claim(5320, " NY ", brand="metformin", generic="METFORMIN", claims=0),
        claim(5330, cost=0.0, year=2021)).orderBy("prscrbr_npi").collect()
    assert (a.prscrbr_state_abrvtn, a.prscrbr_type) == ("NY", "Nurse Practitioner")
    assert (a.is_generic, b.is_generic) == (False, True)
    assert (a.avg_cost_per_claim, c.avg_cost_per_claim) == (8.0, 0.0)
    assert (a._silver_version, c.year) == ("1.0", 2021)


def test_null_key_gives_no_rows(spark):
    assert clean(spark, claim(None)).count() == 0


def test_spellings_of_one_brand_are_one_claim(spark):
    rows = clean(spark, claim(brand=" Advil"), claim(brand="ADVIL "), claim(brand="advil")).collect()
    assert [r.brnd_name for r in rows] == ["ADVIL"]


def test_kept_row_does_not_depend_on_order(spark):
    a, b = claim(cost=10.0, city="B"), claim(cost=20.0, city="A")
    assert clean(spark, a, b).first().prscrbr_city == clean(spark, b, a).first().prscrbr_city == "A"


def test_bad_row_does_not_displace_good_one(spark):
    rows = clean(spark, claim(cost=-1.0, city="A"), claim(cost=7.0, city="B")).collect()
    assert [r.tot_drug_cst for r in rows] == [7.0]


def test_missing_numbers_become_zero(spark):
    row = clean(spark, claim(claims=None, cost=None, benes=None)).first()
    assert (row.tot_clms, row.tot_drug_cst, row.tot_benes, row.avg_cost_per_claim) == (0, 0, 0, 0)


def test_state_length_and_null_state(spark):
    assert clean(spark, claim(state="TEX"), claim(1002, state=None)).count() == 0


def test_null_brand_is_not_generic(spark):
    assert clean(spark, claim(brand=None)).first().is_generic is False


def test_ratio_rounds_half_up(spark):
    assert clean(spark, claim(claims=8, cost=8.04)).first().avg_cost_per_claim == 1.01


def test_copies_of_hot_keys_are_dropped_before_the_shuffle(spark):
    hot = spark.range(5000).select(
        *[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(claim(), RAW)]
    ).withColumn("prscrbr_npi", F.monotonically_increasing_id() % 2)
    assert cleaning.clean_prescriber_drug(hot).count() == 2
    plan = cleaning.clean_prescriber_drug(hot)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange"):]


def test_prescriber_and_drug_cleaners(spark):
    people = spark.createDataFrame(
        [(1, "A", "B", None, " tx", None), (1, "A", "B", "X", "TX", "Y"), (None, "N", "N", "N", "N", "N")],
        "prscrbr_npi long, prscrbr_last_org_name string, prscrbr_first_name string, "
        "prscrbr_city string, prscrbr_state_abrvtn string, prscrbr_type string")
    rows = cleaning.clean_prescriber(people).collect()
    assert [(r.prscrbr_npi, r.prscrbr_city, r.prscrbr_state_abrvtn) for r in rows] == [
        (1, "Unknown", "TX")]
    drugs = spark.createDataFrame([("a", "b"), (" A", "c")], "gnrc_name string, brnd_name string")
    assert [tuple(r)[:2] for r in cleaning.clean_drug(drugs).select("gnrc_name", "brnd_name").collect()
            ] == [("A", "B")]


def test_landing_union_fills_missing_columns(spark):
    bulk = spark.createDataFrame([claim()], RAW)
    both = cleaning.union_landing(bulk, bulk.drop("tot_day_suply"))
    assert both.count() == 2
    assert cleaning.dedup_claims(both).count() == 1


def test_staging_names_and_classes(spark, silver):
    dearer = silver.withColumns({"_silver_ts": F.current_timestamp(),
                                 "avg_cost_per_claim": F.col("avg_cost_per_claim") * 4})
    staged = staging.stg_prescriber_drug(dearer)
    rows = staging.classify_claims(staged).collect()
    assert {r.prescriber_npi for r in rows if r.is_pain_management_specialty} == {32}
    assert {(r.brand_name, r.cost_tier) for r in rows if r.claim_year == 2020} == {
        ("ALLEGRA", "medium"), ("CETIRIZINE", "low")}
    assert dict(staged.dtypes)["total_claims"] == "decimal(18,0)"


def test_null_average_falls_to_the_last_tier(spark):
    from scriptwell.functions.columns import cost_tier
    df = spark.createDataFrame([(None,), (20.0,), (999.99,), (1000.0,)], "a double")
    assert [r[0] for r in df.select(cost_tier("a")).collect()] == [
        "specialty_tier", "medium", "high", "specialty_tier"]
