import re

import pytest
from pyspark.sql import functions as F

from scriptwell.operators import narratives
from scriptwell.plans import layers

SF, YEAR = "/root/testdata/sf0.001", 1998


@pytest.fixture(scope="module")
def tables(spark):
    return layers.gold_tables(spark, SF)


def test_insights(tables):
    top = tables["drug_summary"].filter(F.col("year") == YEAR).orderBy(
        F.desc("total_cost_usd")).first()
    rows = {r.position: r.text for r in narratives.insights(tables, YEAR).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1].startswith(f"{top.gnrc_name} dominates utilization at ${top.total_cost_usd / 1e6:.1f}M")


def test_year_without_claims(tables):
    assert narratives.insights(tables, 1900).count() == 0
    assert narratives.executive_summary(tables, "weekly", 1900).count() == 0
    assert narratives.recommendations(tables, 1900).count() == 0
    assert {r.line_no for r in narratives.report_lines(tables, 1900).collect()} == {0, 1, 2}


def test_summary_and_answers(tables):
    text = narratives.executive_summary(tables, "monthly", YEAR).first().text
    assert text.startswith("During this monthly reporting window") and "%s" not in text
    answers = {r["query"]: r.text for r in narratives.answers(tables, YEAR).collect()}
    assert len(answers) == 6 and re.search(r"Brand: \$[\d,]+ total cost", answers["generic_vs_brand"])


def test_answered_questions(spark, tables):
    routed = spark.createDataFrame(
        [(1, "top_state", 2001), (2, "top_state", 2024), (3, None, 2024)],
        "id int, intent string, year int")
    rows = {r.id: r.answer for r in narratives.answer_questions(
        routed, narratives.answers(tables)).collect()}
    assert "had the highest total drug cost" in rows[1]
    assert rows[2] == "No data found for that year." and rows[3] is None


def test_recommendations_are_ordered_and_data_driven(tables):
    rows = narratives.recommendations(tables, YEAR).orderBy("position").collect()
    assert [r.priority for r in rows] == ["high", "high", "medium"]
    assert rows[0].recommendation.startswith("Enforce step therapy prioritizing")


def test_report_lines(tables):
    lines = narratives.report_lines(tables, YEAR).orderBy("section", "line_no").collect()
    assert lines[0].line == "## Top 10 Drugs by Cost"
    body = [r.line for r in lines if r.section == 2 and r.line_no >= 3]
    assert len(body) == 10 and all(re.match(r"\| \w\w \| \$[\d,]+ \| [\d,]+ \| \$[\d,.]+ \|", x)
                                   for x in body)


def test_period_dates(spark):
    now = F.lit("2024-03-31 10:00:00").cast("timestamp")
    row = spark.range(1).select(*narratives.report_dates(now, "weekly"),
                                narratives.report_dates(now, "monthly")[0]).first()
    assert [str(v) for v in row] == ["2024-03-24", "2024-03-31", "2024-03-01"]
