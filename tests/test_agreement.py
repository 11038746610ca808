import pytest

from riskweave.functions import columns as C, fixed
from riskweave.operators import agreement


@pytest.fixture(scope="module")
def analyzed(spark):
    rows = [(0, 1, 1, .85, .85, .85), (1, 0, 1, .10, .90, .50), (2, 1, 1, .70, .80, .85), (3, 1, 0, .10, .80, .50)]
    df = spark.createDataFrame(rows, "row_id int, y_true int, y_pred int, random_forest double, xgboost double, adaboost double")
    return agreement.analyze(df)


def test_scores_and_levels(analyzed):
    rows = {r.patient_index: r for r in analyzed.collect()}
    assert [round(rows[i].std_dev, 5) for i in range(4)] == [0.0, 0.32660, 0.06236, 0.28674]
    assert [rows[i].agreement_level for i in range(4)] == [
        "high agreement", "low agreement", "moderate agreement", "low agreement"]
    assert [rows[i].is_correct for i in range(4)] == [1, 0, 1, 0]
    assert len(analyzed.columns) == 10


def test_flag_text(spark):
    df = spark.createDataFrame([(.314, .751, .582), (0.125, 0.125, 0.135)], "a double, b double, c double")
    flags = [r.f for r in df.select(C.agreement_flag("a", "b", "c", C.agreement_level(C.spread("a", "b", "c"))).alias("f")).collect()]
    assert flags[0] == ("Model agreement: low agreement — RF: 31%, XGBoost: 75%, AdaBoost: 58%."
                        " Interpret this prediction with extra caution.")
    assert "RF: 12%" in flags[1] and "High consensus" in flags[1]


def test_summary_keeps_empty_levels(analyzed):
    rows = agreement.summarize(analyzed.where("agreement_level != 'moderate agreement'")).orderBy("level_order").collect()
    assert [r.agreement_level for r in rows] == fixed.AGREE_LEVELS
    assert [(r.sample_size, r.accuracy) for r in rows] == [(1, 1.0), (0, None), (2, 0.0)]
    empty = agreement.summarize(analyzed.where("false")).collect()
    assert [(r.sample_size, r.pct_of_total) for r in empty] == [(0, 0.0)] * 3


def test_examples(analyzed):
    got = sorted((r.agreement_level, r.patient_index) for r in agreement.examples(analyzed, 1).collect())
    assert got == [("high agreement", 0), ("low agreement", 1), ("moderate agreement", 2)]


def test_votes(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5), (0.9, 0.4, 0.3), (0.6, 0.6, 0.1)], "a double, b double, c double")
    soft = [r.v for r in df.select(agreement.label_of(agreement.soft_vote("a", "b", "c")).alias("v")).collect()]
    assert soft == [0, 1, 0]
    labels = [agreement.label_of(c) for c in "abc"]
    assert [r.v for r in df.select(agreement.hard_vote(*labels).alias("v")).collect()] == [0, 0, 1]
    assert [r.v for r in df.select(agreement.hard_vote(*labels[:2]).alias("v")).collect()] == [0, 0, 1]
