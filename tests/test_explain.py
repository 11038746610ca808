import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import columns as C
from riskweave.operators import explain, learners, stability

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame(data, "row_id int, a double, b double, c double")
    return df.withColumn("target", ((F.col("a") + F.col("b") * F.col("c")) > 0).cast("int")).cache()


def curved(df, out):
    return df.withColumn(out, F.col("a") * F.col("b") + F.exp(F.col("c") * 0.5))


def f(a, b, c):
    return a * b + math.exp(c * 0.5)


def subset_shapley(value, d):
    phi = []
    for i in range(d):
        total, others = 0.0, [j for j in range(d) if j != i]
        for size in range(d):
            for s in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                total += w * (value({*s, i}) - value(set(s)))
        phi.append(total)
    return phi


def test_shapley_equals_enumeration_and_adds_up(rows):
    ref = {"a": 0.3, "b": -1.0, "c": 0.2}
    out = {r.row_id: r for r in explain.shapley(rows, curved, NAMES, ref).collect()}
    for x in rows.collect():
        r = out[x.row_id]
        want = subset_shapley(lambda s: f(*[x[n] if i in s else ref[n] for i, n in enumerate(NAMES)]), 3)
        assert [r[n] for n in NAMES] == pytest.approx(want)
        assert r.base + sum(r[n] for n in NAMES) == pytest.approx(r.p) == pytest.approx(f(x.a, x.b, x.c))


def test_shapley_of_fourteen_features_equals_enumeration(spark):
    """No stop by the number of features: two of fourteen matter, and share as in a model of two."""
    names = [f"f{i}" for i in range(14)]
    df = spark.createDataFrame([(1, *[1.0 + i for i in range(14)])], "row_id long, " + ", ".join(f"{n} double" for n in names))
    scorer = lambda d, out: d.withColumn(out, F.col("f0") * F.col("f1") + F.col("f13"))
    r = explain.shapley(df, scorer, names, dict.fromkeys(names, 0.0)).collect()[0]
    want = {"f0": 1.0, "f1": 1.0, "f13": 14.0}
    assert [r[n] for n in names] == pytest.approx([want.get(n, 0.0) for n in names]) and r.base == 0.0


def conditional(tree, cuts, x, known, node=0):
    """Expected value of a boosted tree when only the known features are followed."""
    if node not in tree.split:
        return tree.value[node]
    f, cut = tree.split[node]
    left, right = 2 * node + 1, 2 * node + 2
    if f in known:
        return conditional(tree, cuts, x, known, left if x[f] <= cuts[f][cut] else right)
    n, m = tree.cover[left], tree.cover[right]
    return (n * conditional(tree, cuts, x, known, left) + m * conditional(tree, cuts, x, known, right)) / (n + m)


@pytest.mark.parametrize("kind", ["xgboost", "random_forest"])
def test_tree_attribution_equals_enumeration(rows, kind):
    model = learners.LEARNERS[kind](n_estimators=4, max_depth=4).fit(rows, NAMES)
    scored = model.score(rows, "p")
    out = explain.tree_attribution(scored, model, ["row_id", "p"]).collect()
    assert len(out) == 120
    for r in out:
        total = r.base + sum(r[n] for n in NAMES)
        assert total == pytest.approx(math.log(r.p / (1 - r.p)) if kind == "xgboost" else r.p)
    if kind == "xgboost":
        inputs = {x.row_id: [x[n] for n in NAMES] for x in rows.collect()}
        for r in out[:5]:
            x = inputs[r.row_id]
            want = subset_shapley(lambda s: sum(conditional(t, model.cuts, x, s) for t in model.trees), 3)
            assert [r[n] for n in NAMES] == pytest.approx(want)


def ridge(z, y, w, alpha):
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    return np.linalg.solve((zc * w[:, None]).T @ zc + alpha * np.eye(z.shape[1]), (zc * w[:, None]).T @ yc)


def best_forward(z, y, w, k):
    """Features that explain most together, chosen one after the other."""
    used = []
    for _ in range(k):
        left = {}
        for j in range(z.shape[1]):
            if j not in used:
                x = np.column_stack([np.ones(len(y)), z[:, [*used, j]]]) * np.sqrt(w)[:, None]
                fit = np.linalg.lstsq(x, y * np.sqrt(w), rcond=None)[0]
                left[j] = ((x @ fit - y * np.sqrt(w)) ** 2).sum()
        used.append(min(left, key=left.get))
    return np.sort(used)


def test_surrogate_is_the_weighted_ridge_of_its_draws(spark, rows):
    some = rows.where("row_id < 12").withColumn("a", F.when(F.col("row_id") != 3, F.col("a")))
    bins = explain.quartile_bins(rows, NAMES)
    counts = explain.bin_counts(some, NAMES, bins)
    assert all(sum(counts[n]) == 12 - (n == "a") for n in NAMES)
    drawn = explain.draws(spark, NAMES, bins, counts, samples=60).toPandas()
    assert len(drawn) == 59
    for j, n in enumerate(NAMES):
        assert drawn[n].between(bins[n][0], bins[n][-1]).all()
        assert (np.searchsorted(bins[n][1:4], drawn[n], side="left") == drawn[f"__b{j}"]).all()
        assert set(drawn[f"__b{j}"]) <= {k for k in range(4) if counts[n][k]}
    zero = lambda df, out: curved(df.fillna(0.0, NAMES), out)
    full = {r.row_id: r for r in explain.surrogate(some, zero, NAMES, bins, samples=60).collect()}
    two = {r.row_id: r for r in explain.surrogate(some, zero, NAMES, bins, samples=60, top_k=2).collect()}
    assert len(full) == 12
    y_drawn = [f(*v) for v in drawn[NAMES].to_numpy()]
    for x in some.collect():
        own = [-1 if x[n] is None else int(np.searchsorted(bins[n][1:4], x[n], side="left")) for n in NAMES]
        z = np.vstack([np.ones(3), drawn[["__b0", "__b1", "__b2"]].to_numpy() == own]).astype(float)
        y = np.array([f(*[x[n] or 0.0 for n in NAMES]), *y_drawn])
        w = np.exp(-(3 - z.sum(axis=1)) / (2 * 0.75 ** 2 * 3))
        assert [full[x.row_id][n] for n in NAMES] == pytest.approx(ridge(z, y, w, 1.0))
        used = best_forward(z, y, w, 2)
        want = np.zeros(3)
        want[used] = ridge(z[:, used], y, w, 1.0)
        assert [two[x.row_id][n] for n in NAMES] == pytest.approx(want)


def test_surrogate_scores_its_draws_once(spark, rows):
    """Twice the rows, the same draws: the scorer sees samples - 1 inputs and the rows."""
    seen = []

    def counted(df, out):
        seen.append(df)
        return curved(df, out)
    bins = explain.quartile_bins(rows, NAMES)
    explain.surrogate(rows.union(rows.withColumn("row_id", F.col("row_id") + 10_000)), counted, NAMES, bins, samples=200).collect()
    assert [df.count() for df in seen] == [199, 2 * rows.count()]


def test_surrogate_does_not_depend_on_partitioning(rows):
    bins = explain.quartile_bins(rows, NAMES)
    once = {r.row_id: r.a for r in explain.surrogate(rows, curved, NAMES, bins, samples=30).collect()}
    again = {r.row_id: r.a for r in explain.surrogate(rows.repartition(5), curved, NAMES, bins, samples=30).collect()}
    assert once == pytest.approx(again)


def test_compare_tables(rows):
    a = rows.select("row_id", *NAMES)
    b = rows.select("row_id", F.col("a"), (F.col("b") * 0).alias("b"), F.col("c"))
    got = {r.row_id: r for r in explain.compare_tables(a, b, NAMES, k=2).collect()}
    for x in rows.collect():
        top = sorted(NAMES, key=lambda n: -abs(x[n]))[:2]
        second = sorted("ac", key=lambda n: -abs(x[n]))
        r = got[x.row_id]
        assert r.shap_top_features == ", ".join(top) and r.lime_top_features == ", ".join(second)
        assert r.overlap_count == len(set(top) & set(second))
        assert r.agreement_status == ("Strong Agreement" if r.overlap_count == 2 else "Partial/Divergent Agreement")


def one(spark, expr, **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{n} array<string>" for n in arrays))
    return df.select(expr.alias("v")).collect()[0].v


def test_ranking_fixtures(spark):
    a = ["cp", "oldpeak", "thal", "exang", "age", "sex"]
    b = ["cp", "oldpeak", "thal", "chol", "sysBP", "sex"]
    assert one(spark, C.overlap_ratio("a", "b", 3), a=a, b=b) == 1.0
    assert one(spark, C.overlap_ratio("a", "b", 5), a=a, b=b) == 0.6
    abcd = list("abcd")
    assert one(spark, stability.kendall_tau("a", "b"), a=abcd, b=abcd) == 1.0
    assert one(spark, stability.kendall_tau("a", "b"), a=abcd, b=abcd[::-1]) == -1.0
    assert one(spark, stability.kendall_tau("a", "b"), a=["a", "x"], b=["a", "y"]) == 0.0


def test_rank_ties_put_the_later_feature_first(spark):
    df = spark.createDataFrame([(0, 1.0, -1.0, 0.5)], "fold int, a double, b double, c double")
    ranked = explain.rank_features(explain.importance(df, NAMES, ["fold"]), ["fold"]).orderBy("rank")
    assert [r.feature for r in ranked.collect()] == ["b", "a", "c"]
    top = df.select(explain.top_features({n: F.col(n) for n in NAMES}, 2).alias("t"), explain.contributions(
        {n: F.col(n) for n in NAMES}, 1).alias("c")).collect()[0]
    assert top.t == ["b", "a"]
    assert (top.c[0].impact, top.c[0].summary) == ("decreases risk", "b (decreases risk, SHAP impact: -1.000)")


def test_stability_summary(spark):
    rows = [(f, n, i) for f, order in enumerate(["abc", "abc", "acb"]) for i, n in enumerate(order)]
    ranked = spark.createDataFrame(rows, "fold int, feature string, rank int")
    r = stability.summarize(ranked, folds=3, k=2).collect()[0]
    assert r.mean_overlap_at_k == pytest.approx((1 + 0.5 + 0.5) / 3) and r.mean_kendall_tau == pytest.approx((1 + 2 / 3) / 3)
    assert r.interpretation.startswith("Moderate Explanation Stability: Top-2")
    single = stability.summarize(ranked.where("fold = 0"), folds=1, k=2).collect()[0]
    assert (single.mean_overlap_at_k, single.mean_kendall_tau) == (1.0, 1.0)
    lists = {x.fold: x.features for x in stability.fold_lists(ranked).collect()}
    assert lists[2] == ["a", "c", "b"]


def test_stability_of_fitted_models(rows):
    from riskweave.plans import stability as plan

    out = plan.evaluate(rows, outer=2, k=2, params={"n_estimators": 2, "max_depth": 2}).collect()[0]
    assert 0 <= out.mean_overlap_at_k <= 1 and -1 <= out.mean_kendall_tau <= 1


def test_rule_feature(spark):
    df = spark.createDataFrame([("chol <= 1",), ("0 < thalach",), ("what",)], "r string")
    names = ["thal", "thalach", "chol"]
    assert [r.f for r in df.select(C.rule_feature("r", names).alias("f")).collect()] == ["chol", "thal", "what"]


def test_uniforms_are_stable_and_even(spark):
    u = np.array([r.u for r in spark.range(2000).select(C.unit_uniform("id", F.lit(7)).alias("u")).collect()])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03


def test_surrogate_inverts_per_pattern_and_not_per_row(monkeypatch):
    rng, d, k = np.random.default_rng(5), 4, 2
    z = (rng.random((3, 40, d)) < 0.4).astype(float)
    z[2, :, 1] = z[2, :, 0]                                         # two features that always go together
    w, p = rng.random((3, 40)), rng.random((3, 40))
    upper = np.triu_indices(d)
    sums = np.stack([np.concatenate([[w[i].sum(), w[i] @ p[i]], w[i] @ z[i], (w[i] * p[i]) @ z[i], ((z[i] * w[i][:, None]).T @ z[i])[upper]]) for i in range(3)])
    place, own = rng.integers(0, 3, 5000), rng.random(5000)
    inverted, plain = [], np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda a, **how: inverted.append(len(a)) or plain(a, **how))
    found = explain.ridge_weights(sums, place, own, d, k, 1.0)
    assert sum(inverted) <= 3 * d + 3 * d * d                        # per step: patterns times features used times features
    for n in range(0, 5000, 250):
        i = place[n]
        zs, ws, ps = np.vstack([np.ones(d), z[i]]), np.append(1.0, w[i]), np.append(own[n], p[i])
        zc, pc = zs - ws @ zs / ws.sum(), ps - ws @ ps / ws.sum()
        a, b, used = (zc * ws[:, None]).T @ zc, (zc * ws[:, None]).T @ pc, []
        for _ in range(k):
            gain = {j: b[[*used, j]] @ np.linalg.lstsq(a[np.ix_([*used, j], [*used, j])], b[[*used, j]], rcond=1e-12)[0] for j in range(d) if j not in used}
            used.append(max(gain, key=gain.get))
        if i == 2 and {0, 1} & set(used):
            continue                                                # equal gains: either of the two
        want = np.zeros(d)
        want[sorted(used)] = np.linalg.solve(a[np.ix_(sorted(used), sorted(used))] + np.eye(k), b[sorted(used)])
        assert np.allclose(found[n], want)


def test_attributions_from_tables_equal_those_by_pattern(rows, monkeypatch):
    """Leaves of few conditions are looked up in a table of all patterns, others by the patterns that occur."""
    assert explain.SHORT > 3
    model = learners.LEARNERS["xgboost"](n_estimators=5, max_depth=4).fit(rows, NAMES)
    run = lambda: {r.row_id: [r[n] for n in NAMES] for r in explain.tree_attribution(rows, model, ["row_id"]).collect()}
    got = run()
    monkeypatch.setattr(explain, "SHORT", 0)
    want = run()
    assert len(got) == 120 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
