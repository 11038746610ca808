import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import calibration, fairness, metrics, ranks


def frame(spark, y, pred=None, prob=None, **extra):
    pred = pred or [0] * len(y)
    prob = prob or [0.0] * len(y)
    names = ["y_true", "y_pred", "y_prob", *extra]
    rows = [tuple(v) for v in zip(y, pred, prob, *extra.values())]
    types = ["int", "int", "double", *["string" for _ in extra]]
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def test_golden_metrics(spark):
    df = frame(spark, [0, 1, 1, 0, 1], [0, 1, 0, 0, 1], [.1, .9, .4, .2, .8])
    r = metrics.extended(df).collect()[0]
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 1, 2)
    assert r.accuracy == pytest.approx(0.8) and r.specificity == 1.0 and r.is_degenerate is False
    assert (r.precision, round(r.recall, 4), round(r.f1, 4)) == (1.0, 0.6667, 0.8)
    assert r.roc_auc == pytest.approx(1.0) and r.pr_auc == pytest.approx(1.0)
    assert calibration.brier(df).collect()[0].brier == pytest.approx(0.092)
    assert metrics.extended(df, score=None).collect()[0].roc_auc is None


def test_pr_auc_with_tie_at_the_top(spark):
    df = frame(spark, [0, 1, 1, 0], prob=[.9, .9, .4, .2])
    assert metrics.rank_metrics(df).collect()[0].pr_auc == pytest.approx(2 / 3)


def test_one_class_and_degenerate_groups(spark):
    df = frame(spark, [1, 1, 0, 0], [1, 1, 0, 1], [.9, .8, .1, .7], g=["a", "a", "b", "b"])
    got = {r.g: r for r in metrics.extended(df, ["g"]).collect()}
    assert got["a"].roc_auc is None and got["a"].pr_auc is None and got["a"].specificity is None
    assert got["a"].is_degenerate is True and got["b"].is_degenerate is False
    assert got["b"].recall == 0.0 and got["b"].specificity == 0.5


def pair_auc(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels,buckets", [(7, 4), (1000, 16), (3, 50), (200, 1)])
def test_auc_equals_pair_count_whatever_the_cuts(spark, levels, buckets):
    rng = random.Random(levels)
    # a narrow dense range and one hot score hold most of the rows
    rows = [
        (str(i % 3), rng.randint(0, 1), 0.5 if i % 3 == 0 else 0.5 + rng.randrange(levels) / levels / 1e4)
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "g string, y_true int, y_prob double")
    cuts = ranks.cut_points(df, "y_prob", buckets)
    assert len(cuts) < max(buckets, 1)
    got = {r.g: r.roc_auc for r in metrics.rank_metrics(df, ["g"], cuts=cuts).collect()}
    for g in "012":
        assert got[g] == pytest.approx(pair_auc([(y, p) for k, y, p in rows if k == g]))


def test_running_totals_brute_force(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice([None, "a", "b"]), rng.randrange(80)) for _ in range(200)}, key=str)
    rows = [(k, float(v), rng.randrange(5)) for k, v in rows]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    out = ranks.running_totals(df, ["k"], "v", ["n"], [10.0, 20.0, 55.0]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.below_n == sum(n for k, v, n in rows if k == r.k and v < r.v)
        assert r.total_n == sum(n for k, v, n in rows if k == r.k)


def test_calibration_golden(spark):
    assert calibration.brier(frame(spark, [0, 1, 1, 0], prob=[.1, .9, .8, .2])).collect()[0].brier == pytest.approx(0.025)
    for probs, want in (([1.0, 1.0, 0.0, 0.0], 0.0), ([.9, .9, .1, .1], 0.10)):
        df = frame(spark, [1, 1, 0, 0], prob=probs)
        assert calibration.ece(df, n_bins=5).collect()[0].ece == pytest.approx(want)


def test_bin_edges(spark):
    df = frame(spark, [1, 1, 1, 1], prob=[0.3, 0.1, 1.0, 0.0])
    # 0.3 lies below the edge 3 * 0.1
    left = sorted(r.bin for r in df.select(calibration.C.bin_left_closed("y_prob", 10).alias("bin")).collect())
    assert left == [0, 1, 2, 9]
    right = sorted((r.mean_predicted, r.bin) for r in calibration.reliability_curve(df).collect())
    assert right == [(0.05, 0), (0.3, 2), (1.0, 9)]


def test_out_of_range_scores_count_in_the_total_only(spark):
    df = frame(spark, [1, 0], prob=[0.5, 1.5])
    assert calibration.ece(df).collect()[0].ece == pytest.approx(0.25)


def test_platt_and_isotonic(spark):
    df = frame(spark, [0, 0, 0, 1, 1, 1], prob=[.2, .3, .6, .4, .7, .8])
    fitted = calibration.PlattScaler.fit(df)
    assert fitted.slope == pytest.approx(7.32264, abs=2e-3) and fitted.intercept == pytest.approx(-3.66132, abs=1e-3)
    iso = calibration.IsotonicCalibrator.fit(df)
    probe = spark.createDataFrame([(0.0,), (.25,), (.5,), (.75,), (1.0,)], "p double")
    got = [r.o for r in iso.transform(probe, "p", "o").collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0]
    separable = frame(spark, [0, 0, 0, 1, 1, 1], prob=[.2, .3, .4, .6, .7, .8])
    platt = calibration.PlattScaler.fit(separable)
    assert all(0 <= r.q <= 1 for r in probe.select(platt.column("p").alias("q")).collect())


def test_fold_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 3.0)], "model string, fold int, acc double")
    r = metrics.fold_summary(df, ["model"], ["acc"]).collect()[0]
    assert (r.acc_mean, r.acc_std) == (2.0, 1.0)


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    got = {r.bin: r.n for r in metrics.histogram(df, "v", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    assert metrics.histogram(df.where("v = 1"), "v", 5).agg(F.sum("n")).first()[0] == 1


def test_subgroups_sum_and_order(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(30, 80)), float(rng.randint(0, 1)), rng.choice("xy"), rng.randint(0, 1), rng.random())
            for i in range(300)]
    df = spark.createDataFrame(rows, "row_id int, age double, sex double, source_site string, y_true int, y_prob double")
    df = fairness.with_groups(df).withColumn("y_pred", (F.col("y_prob") > 0.5).cast("int"))
    out = fairness.breakdown(df).collect()
    for dim in ("sex_label", "age_band", "source_site"):
        part = [r for r in out if r.dimension == dim]
        assert sum(r.sample_size for r in part) == 300
        single = {r.subgroup: r for r in fairness.subgroups(df, dim).collect()}
        for r in part:
            for name in fairness.ALL_COLUMNS:
                assert getattr(r, name) == pytest.approx(getattr(single[r.subgroup], name)), name
    bands = [r.subgroup for r in fairness.subgroups(df, "age_band").orderBy("subgroup").collect()]
    assert bands == ["50-60", "< 50", "> 60"]
    assert [r.dimension for r in fairness.breakdown(df.drop("source_site")).select("dimension").distinct().orderBy("dimension").collect()] == ["age_band", "sex_label"]


def test_breakdown_leaves_out_rows_without_label_prediction_or_score(spark):
    nan = float("nan")
    rows = [("a", "x", 1, 1, .9), ("a", "x", 0, 0, .2), ("a", None, 1, 0, .4), (None, "x", 0, 1, .6), ("b", "x", 1, 1, .6),
            ("c", "x", None, 1, .9), ("c", "y", 1, None, .9), ("c", "y", 1, 1, None), ("c", "y", 1, 1, nan), ("a", "x", 0, 1, .9)]
    df = spark.createDataFrame(rows, "sex_label string, age_band string, y_true int, y_pred int, y_prob double")
    for n in (1, 100):
        out = {(r.dimension, r.subgroup): (r.sample_size, r.roc_auc) for r in fairness.breakdown(df, rows_per_task=n).collect()}
        assert out == {("sex_label", "a"): (4, 0.625), ("sex_label", "b"): (1, None), ("age_band", "x"): (5, pytest.approx(4 / 6))}


def test_histogram_shows_empty_bins(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.05), ("b", None)], "k string, v double")
    got = {(r.k, r.bin): r.n for r in metrics.histogram(df, "v", 4, ["k"]).collect()}
    assert got == {(k, b): int((k, b) in {("a", 0), ("a", 3), ("b", 0)}) for k in "ab" for b in range(4)}


def test_rows_without_a_score_do_not_rank(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (1, 0, None)], "y_true int, y_pred int, y_prob double")
    both = metrics.extended(df).first(), metrics.rank_metrics(df).first()
    assert both[0].roc_auc == both[1].roc_auc == 1.0 and both[0].n == 2
