import numpy as np
import pandas as pd
import pytest

from riskweave.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, weights="one"):
    """{vec_id: (deviation, whitened up to sign)}, n, shares, over plain loops and numpy's eigh."""
    good = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v, *_ in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    counts = {}
    for _, x in good:
        counts[tuple(x)] = counts.get(tuple(x), 0) + 1
    fit = [(x, c if weights == "counts" else 1) for x, c in counts.items()]
    n = sum(w for _, w in fit)
    sums = [sum(w * x[j] for x, w in fit) for j in range(len(good[0][1]))]
    y = np.array([[x[j] - sums[j] / n for j in range(len(sums))] for x, _ in fit])
    cov = (y * np.array([w for _, w in fit])[:, None]).T @ y / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        z = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(e)
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(x, sums)), z)
    return out, n, e / np.trace(cov)


def check(df, rows, **kw):
    got = df.toPandas()
    want, n, shares = brute(rows, **kw)
    assert set(got.vec_id) == set(want)
    assert (got.n == n).all() and (got.identity_error <= 1e-4).all() and got.identity_error.nunique() == 1
    wide = got.pivot_table(index="vec_id", columns="component", values="whitened")
    ids = wide.index.tolist()
    expected = np.array([want[i][1] for i in ids])
    sign = np.sign((wide.to_numpy() * expected).sum(axis=0))
    assert np.allclose(wide.to_numpy() * sign, expected, atol=1e-6)
    assert {(i, d) for i, d in zip(got.vec_id, got.deviation)} == {(i, want[i][0]) for i in want}
    for c, share in enumerate(shares, 1):
        assert np.allclose(got[got.component == c].explained, share, rtol=1e-6)


def test_equals_plain_fit_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r[0], list(r[1]) if r[1] is not None else None) for r in df.select("vec_id", "embedding").collect()]
    check(W.whiten(df), rows)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_hot_vector_nulls_and_clashing_columns(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)).astype(np.float32).tolist()
    rows = [(i, v, 1) for i, v in enumerate(base)] + [(1_000 + i, base[7], None) for i in range(40)]
    rows += [(2_000, None, 1), (2_001, [], 1), (2_002, [1.0, None, 2.0, 3.0, 4.0], 1), (2_003, [1.0, float("nan"), 0.0, 0.0, 0.0], 1),
             (2_004, [1.0, float("inf"), 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("x", "dims", "key", "slot", "copies", "row", "n", "whitened"):
        df = df.withColumn(c, df["label"])
    check(W.whiten(df.repartition(7), weights=weights, components=5), rows, k=5, weights=weights)


def test_repeated_rows_and_null_ids_are_whitened_each(spark):
    rows = [(1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (None, [1.0, 0.5], 0), (None, [1.0, 0.5], 0), (4, [3.0, -2.0], 0), (5, [0.2, 0.1], 0)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 12 and got.vec_id.isna().sum() == 4 and (got.n == 4).all()


def test_no_rows_one_row_and_no_variance(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert W.whiten(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    got = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)).toPandas()
    assert len(got) == 4 and got.whitened.isna().all() and got.explained.isna().all() and got.identity_error.isna().all() and (got.deviation == 0).all()
    flat = W.whiten(spark.createDataFrame([(i, [float(i), 2.0], 1) for i in range(4)], SCHEMA)).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component == 2].whitened.isna().all()
    assert (flat.identity_error < 1e-9).all()


def test_lengths_are_fitted_apart_and_far_entries_stay(spark):
    rows = [(i, [float(i % 3), float(i % 5)], 1) for i in range(15)] + [(100 + i, [float(i), float(i * i), 1.0 - i], 1) for i in range(6)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert (got[got.vec_id < 100].n == 15).all() and (got[got.vec_id >= 100].n == 6).all()
    far = W.whiten(spark.createDataFrame([(1, [1e30, 0.0], 1), (2, [-3e38, 1.0], 1), (3, [0.0, 0.5], 1)], SCHEMA)).toPandas()
    assert far[far.component == 1].whitened.notna().all()
    assert far[far.vec_id == 1].deviation.isna().all()


def test_exact_deviations_near_the_limit_of_a_long():
    w = W.Whitener(3, [1, 2], np.eye(2), np.ones(2), 2.0)
    for big in (1_000_000_000, 1_012_333_499, 1_012_333_501, 3_000_000_000):
        x = np.array([[big, 5]], np.int64)
        value = (3 * big - 1) ** 2 + (15 - 2) ** 2
        assert w.deviations(x) == [value if value < 1 << 63 else None]


def test_large_weights_sum_exactly(spark):
    big = (1 << 40) + 1
    x = np.array([[1 << 61, -(1 << 60) - 1], [5, 7]], "<i8")
    df = spark.createDataFrame([(2, bytearray(x[0].tobytes()), big), (2, bytearray(x[1].tobytes()), 2)], "dims int, x binary, weight long")
    small = W.sums(df.withColumn("weight", df["weight"] * 0 + 1))
    assert small == {2: (2, [(1 << 61) + 5, -(1 << 60) - 1 + 7])}
    assert W.sums(df) == {2: (big + 2, [big * (1 << 61) + 10, big * (-(1 << 60) - 1) + 14])}
