import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import folds, prepare


def test_ten_row_medians(ten_rows):
    stats = prepare.fit(ten_rows, ["age", "chol"]).stats[None]
    assert (stats["age"].fill, stats["chol"].fill) == (59.5, 243.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 11, 101, 500])
@pytest.mark.parametrize("kind", ["dense", "ties", "gaps"])
def test_median_mean_std_equal_numpy(spark, n, kind):
    rng = random.Random(n)
    make = {"dense": rng.random, "ties": lambda: float(rng.randrange(3)),
            "gaps": lambda: None if rng.random() < 0.4 else rng.gauss(0, 1)}[kind]
    values = [make() for _ in range(n)] + [0.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id int, x double")
    s = prepare.fit(df, ["x"]).stats[None]["x"]
    present = [v for v in values if v is not None]
    filled = [np.median(present) if v is None else v for v in values]
    assert s.fill == np.median(present)
    assert s.mean == pytest.approx(np.mean(filled)) and s.std == pytest.approx(np.std(filled))


def test_many_values_near_the_median_are_split(spark):
    values = [float(v) for v in np.random.default_rng(0).normal(size=2001)]
    df = spark.createDataFrame([(v, i % 4) for i, v in enumerate(values)], "x double, fold int")
    assert prepare.fit(df, ["x"]).stats[None]["x"].fill == np.median(values)
    fitted = prepare.fit(df, ["x"], fold_col="fold", k=4)
    for f in range(4):
        assert fitted.stats[f]["x"].fill == np.median([v for i, v in enumerate(values) if i % 4 != f])


def test_wrong_bracket_is_widened(spark, monkeypatch):
    monkeypatch.setattr(prepare, "_MARGIN", -0.3)
    values = [float(v) for v in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert prepare.fit(df, ["x"]).stats[None]["x"].fill == 50.0


def test_folds_use_other_rows_only(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, None if rng.random() < 0.2 else rng.gauss(i % 3, 1), rng.randrange(3)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id int, fold int, x double, c int")
    fitted = prepare.fit(df, ["x"], ["c"], fold_col="fold", k=3)
    for f in range(3):
        train = [x for _, g, x, _ in rows if g != f]
        present = [x for x in train if x is not None]
        med = np.median(present)
        filled = [med if x is None else x for x in train]
        s = fitted.stats[f]["x"]
        assert s.fill == pytest.approx(med) and s.mean == pytest.approx(np.mean(filled)) and s.std == pytest.approx(np.std(filled))
        counts = {v: sum(1 for _, g, _, c in rows if g != f and c == v) for v in range(3)}
        assert fitted.stats[f]["c"].fill == min(counts, key=lambda v: (-counts[v], v))
    out = {r.row_id: r for r in fitted.transform_folds(df, ["row_id", "fold"]).collect()}
    for i, g, x, _ in rows:
        s = fitted.stats[g]["x"]
        assert out[i].x == pytest.approx(((s.fill if x is None else x) - s.mean) / s.std)


def test_one_hot_mode_and_unknown(spark):
    df = spark.createDataFrame([(1, 2, "b"), (2, 1, "a"), (3, None, None), (4, 2, "a"), (5, 1, "b")], "row_id int, c int, s string")
    fitted = prepare.fit(df.select("row_id", "c"), [], ["c"])
    assert fitted.stats[None]["c"].fill == 1.0  # tie goes to the smallest
    assert fitted.feature_names() == ["c_1", "c_2"]
    new = spark.createDataFrame([(9, 7), (8, None)], "row_id int, c int")
    assert [tuple(r) for r in fitted.transform(new, keep=["row_id"]).collect()] == [(9, 0.0, 0.0), (8, 1.0, 0.0)]
    text = prepare.fit(df.select("s"), [], ["s"])
    assert text.feature_names() == ["s_a", "s_b"]


def test_category_limit(spark):
    df = spark.range(50).select(F.col("id").cast("int").alias("c"))
    with pytest.raises(ValueError, match="50 categories"):
        prepare.fit(df, [], ["c"], max_categories=10)


def test_modes_of_any_number_of_categories(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id")).alias("c")).union(spark.createDataFrame([("v7",)], "c string"))
    assert prepare.fit(df, [], ["c"], one_hot=False).stats[None]["c"].fill == "v7"


def test_names_show_a_category_in_its_own_type(spark):
    df = spark.createDataFrame([(1.0, 1, "1"), (2.5, 2, "b")], "d double, i int, s string")
    assert prepare.fit(df, [], ["d", "i", "s"]).feature_names() == ["d_1.0", "d_2.5", "i_1", "i_2", "s_1", "s_b"]
    assert prepare.fit(df, [], ["d"]).feature_names() == ["d_1.0", "d_2.5"]


def test_constant_and_empty_features(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    fitted = prepare.fit(df, ["a", "b"])
    assert fitted.dropped() == ["b"] and fitted.feature_names() == ["a"]
    assert [r.a for r in fitted.transform(df).collect()] == [0.0, 0.0]


def test_statistics_survive_as_table(spark, ten_rows):
    fitted = prepare.fit(ten_rows.withColumn("cp", F.col("cp").cast("int")), ["age", "chol"], ["cp"])
    again = prepare.Preparation.from_frame(fitted.to_frame(spark))
    a = [tuple(r) for r in fitted.transform(ten_rows, keep=["row_id"]).orderBy("row_id").collect()]
    b = [tuple(r) for r in again.transform(ten_rows, keep=["row_id"]).orderBy("row_id").collect()]
    assert a == b and fitted.feature_names() == again.feature_names()


def test_text_categories(spark):
    rows = [(1, 0, "b", 1.0), (2, 0, "a", 2.0), (3, 1, None, 3.0), (4, 1, "a", None)]
    df = spark.createDataFrame(rows, "row_id int, fold int, s string, x double")
    fitted = prepare.fit(df, ["x"], ["s"])
    again = prepare.Preparation.from_frame(fitted.to_frame(spark))
    assert again.stats[None]["s"].fill == "a" and again.feature_names() == ["x", "s_a", "s_b"]
    got = [tuple(r) for r in again.transform(df, keep=["row_id"], scale=False).orderBy("row_id").collect()]
    assert got == [(1, 1.0, 0.0, 1.0), (2, 2.0, 1.0, 0.0), (3, 3.0, 1.0, 0.0), (4, 2.0, 1.0, 0.0)]
    by_fold = prepare.fit(df, ["x"], ["s"], fold_col="fold", k=2)
    out = by_fold.transform_folds(df, ["row_id"], scale=False).orderBy("row_id").collect()
    assert [(r.s, r.x) for r in out] == [("b", 1.0), ("a", 2.0), ("a", 3.0), ("a", 1.5)]


def test_text_and_number_categories_together(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", None)], "s string, c int")
    fitted = prepare.fit(df, [], ["s", "c"])
    assert fitted.feature_names() == ["s_a", "s_b", "c_1", "c_2"]
    assert [tuple(r) for r in fitted.transform(df).collect()] == [
        (0.0, 1.0, 1.0, 0.0), (1.0, 0.0, 0.0, 1.0), (1.0, 0.0, 1.0, 0.0)]


def test_harmonized_fit(spark):
    df = spark.createDataFrame([(50.0, 1.0, 120.0, 200.0, None, 1), (60.0, 0.0, None, 240.0, 1.0, 0)],
                               "age double, sex double, sysBP double, totChol double, diabetes double, target int")
    assert prepare.fit_harmonized(df).feature_names() == ["age", "sex", "sysBP", "totChol", "diabetes"]


def test_stratified_folds_and_holdout(spark):
    df = spark.range(203).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = folds.stratified(df, "row_id", "y", 5)
    for y in (0, 1):
        sizes = [r["count"] for r in out.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = folds.stratified(df.repartition(7), "row_id", "y", 5)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert folds.stratified(df, "row_id", "y", 5, seed=1).join(out, ["row_id", "fold"]).count() < 203
    held = folds.holdout(df, "row_id", "y", 0.25).where("is_holdout = 1")
    assert held.count() == 51 and held.where("y = 1").count() == 5
    assert folds.quotas({0: 5, 1: 5}, 0.25) == {0: 2, 1: 1}
