"""Shapes of physical plans that scale depends on."""

import re

import pytest
from pyspark.sql import functions as F

from riskweave.operators import counterfactual, fairness, metrics, prepare
from riskweave.queries import base, catalog
from riskweave.queries.explained import _cf_score

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# queries that only build a plan, or fit something small first
PLANNED = sorted(set(catalog.ORACLES) - {"score_stream"})


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_missingness_reads_the_table_once_and_only_needed_columns(spark):
    text = plan(catalog.QUERIES["missingness_report"](spark, SF))
    assert text.count("FileScan parquet") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_shipdate" not in schema and "l_linestatus" not in schema


def test_counterfactuals_shuffle_once(spark):
    df = base.clean(spark, SF)
    text = plan(counterfactual.find(df, _cf_score))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_agreement_and_prepared_rows_do_not_shuffle(spark):
    assert "Exchange hashpartitioning" not in plan(catalog.QUERIES["agreement_flags"](spark, SF))
    df = base.clean(spark, SF)
    assert "Exchange hashpartitioning" not in plan(prepare.fit(df, ["chol", "age"]).transform(df))


def test_rank_metrics_share_the_counting_shuffle(spark):
    oof = base.oof(spark, SF)
    for df in (metrics.extended(oof, ["model"]), metrics.rank_metrics(oof, ["model"])):
        df.collect()
        text = plan(df)
        assert "ReusedExchange" in text and text.count("FileScan") == 1


def test_fairness_reads_the_table_once(spark):
    df = fairness.breakdown(fairness.with_groups(base.scored(spark, SF)), score="ensemble")
    df.collect()
    assert plan(df).count("FileScan") == 1


def test_counterfactual_tasks_hold_a_bounded_number_of_rows(spark, ten_rows):
    """The shuffle is asked for by number: more rows make more tasks, whatever the number of shuffle partitions."""
    df = ten_rows.drop("target")
    few, many = (counterfactual.find(df, _cf_score, rows_per_task=n) for n in (1000, 1))
    assert "hashpartitioning(row_id#" in plan(many) and ", 10), REPARTITION_BY_NUM" in plan(many)
    assert ", 4), REPARTITION_BY_NUM" in plan(few)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_fairness_ranges_hold_a_bounded_number_of_rows(spark):
    df = fairness.with_groups(base.scored(spark, SF)).select("sex_label", "age_band", "source_site", "y_true", "y_pred", "ensemble")
    few, many = (fairness.breakdown(df, score="ensemble", rows_per_task=n) for n in (10**9, 100))
    tasks = -(-df.count() // 100)
    assert f", {tasks}), REPARTITION_BY_NUM" in plan(many) and "Join" not in plan(many)
    measured = lambda d: {(r.dimension, r.subgroup): [r[c] for c in fairness.ALL_COLUMNS] for r in d.collect()}
    a, b = measured(few), measured(many)
    assert len(a) > 5 and set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)


def test_fairness_code_of_the_scan_can_be_compiled(spark, capsys):
    """The JVM never compiles a method of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before a run
    try:
        fairness.breakdown(fairness.with_groups(base.scored(spark, SF)), score="ensemble").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_folds_read_the_ids_twice_at_most(spark):
    df = catalog.QUERIES["stratified_folds"](spark, SF)
    df.collect()
    assert plan(df).count("FileScan") <= 2


def test_first_rows_per_level_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["agreement_examples"](spark, SF))


def test_filter_reaches_the_scan(spark):
    orders = base.table(spark, SF, "orders").where(F.col("o_totalprice") > 100000.0).select("o_orderkey")
    text = plan(orders)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)]" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
