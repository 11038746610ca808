import numpy as np
import pandas as pd

from riskweave.llm import quality_classifier as C

SF = "/root/testdata/sf0.1"


def test_separates_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = C.learn(docs, labels.selectExpr("doc_id", "quality * (2 - toxic) AS grade"))
    other = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1").join(labels, "doc_id")
    got = C.scores(other, model, at_least=1).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert got.kept[got.quality == 1].mean() > 0.99
    assert got.kept[got.quality == 0].mean() < 0.15
    assert (np.diff(model.thresholds) > 0).all()


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(3000)
    y = np.digitize(2 * x + rng.logistic(size=3000), [-2.0, 0.5, 3.0])
    model = C.fit([(np.array([3]), np.array([v])) for v in x], y, buckets=8)
    assert abs(model.weights[3] - 2) < 0.3
    assert abs(model.thresholds - np.array([-2.0, 0.5, 3.0])).max() < 0.4


def test_odd_input(spark):
    ratings = spark.createDataFrame([(1, 0), (2, 2), (2, 1), (None, 2), (3, None)], "doc_id long, grade int")
    docs = spark.createDataFrame([(1, "BAD!! BAD!!", 1), (2, "a calm text", 1), (3, None, 1), (None, "", 1), (2, "a calm text", 1)], "doc_id long, text string, kept int")
    got = C.scores(docs, C.learn(docs, ratings), at_least=1).collect()
    assert len(got) == 5 and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 1 for r in got)
    empty = C.learn(docs, ratings.limit(0))
    assert all(r.expected_grade == 0 and not r.kept for r in C.scores(docs, empty, at_least=1).collect())
    assert C.scores(docs.limit(0), empty, at_least=1).collect() == []
