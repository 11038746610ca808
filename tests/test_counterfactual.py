import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import fixed
from riskweave.operators import counterfactual as cf
from riskweave.sources import sinks

FEATURES = ["chol", "trestbps", "thalach", "oldpeak"]


def scorer(df, out):
    c, b, h, o = (F.coalesce(F.col(f), F.lit(d)) for f, d in zip(FEATURES, (240.0, 140.0, 140.0, 1.0)))
    return df.withColumn(out, 0.25 * c / 500.0 + 0.25 * b / 200.0 + 0.2 * (1.0 - h / 220.0) + 0.35 * o / 6.0
                         + F.when((c > 180.0) & (c < 190.0), 0.3).otherwise(0.0))


def score(c, b, h, o):
    c, b, h, o = (d if v is None else v for v, d in zip((c, b, h, o), (240.0, 140.0, 140.0, 1.0)))
    return 0.25 * c / 500.0 + 0.25 * b / 200.0 + 0.2 * (1.0 - h / 220.0) + 0.35 * o / 6.0 + (0.3 if 180 < c < 190 else 0.0)


def brute(values, t=0.5):
    """Plain search over the same grids."""
    x = dict(zip(FEATURES, values))
    ends = {"chol": lambda v: max(100.0, v * 0.4), "trestbps": lambda v: max(90.0, v * 0.6),
            "thalach": lambda v: min(210.0, v * 1.5), "oldpeak": lambda v: 0.0}
    change = lambda new, old: abs(new - old) / (old if old != 0 else 1.0)
    p = lambda **kw: score(*[kw.get(f, x[f]) for f in FEATURES])
    p0 = p()
    if p0 <= t:
        return p0, None
    grid = {f: lambda n, f=f: np.linspace(x[f], ends[f](x[f]), n) for f in FEATURES}
    options = []
    for k, f in enumerate(FEATURES):
        if x[f] is not None:
            hits = [(i, v) for i, v in enumerate(grid[f](50)) if p(**{f: v}) < t]
            if hits:
                options.append((change(hits[0][1], x[f]), k, ("single", f, hits[0][1], None, None)))
    if not options:
        n = 0
        for i, f in enumerate(FEATURES):
            for g in FEATURES[i + 1:]:
                n += 1
                if x[f] is None or x[g] is None:
                    continue
                for a, v in enumerate(grid[f](15)):
                    hits = [w for w in grid[g](15) if p(**{f: v, g: w}) < t]
                    if hits:
                        options.append((change(v, x[f]) + change(hits[0], x[g]), (n, a), ("dual", f, v, g, hits[0])))
    if not options:
        return p0, None
    best = min(options, key=lambda o: (o[0], o[1]))
    return p0, (best[0], *best[2])


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(11)
    maybe = lambda v: None if rng.random() < 0.1 else v
    rows = [(i, maybe(rng.uniform(80, 600)), maybe(rng.uniform(80, 220)), maybe(rng.uniform(60, 220)),
             maybe(rng.choice([0.0, rng.uniform(-1, 7)]))) for i in range(80)]
    rows += [(90, 600.0, 220.0, 60.0, 7.0), (91, 590.0, 219.0, 61.0, 6.9), (92, None, None, None, None)]
    return spark.createDataFrame(rows, "row_id int, " + ", ".join(f"{f} double" for f in FEATURES))


def test_search_equals_plain_loops(cohort):
    got = {r.row_id: r for r in cf.find(cohort, scorer).collect()}
    assert len(got) == cohort.count()
    kinds = set()
    for x in cohort.collect():
        r = got[x.row_id]
        p0, want = brute([x[f] for f in FEATURES])
        assert r.initial_prob == pytest.approx(p0)
        assert r.flipped == (want is not None)
        if want is None:
            kinds.add("low" if p0 <= 0.5 else "none")
            assert r.details is None
            continue
        pct, kind, f1, v1, f2, v2 = want
        kinds.add(kind)
        d = r.details
        assert (d.type, d.f1, d.f2) == (kind, f1, f2)
        assert d.new_v1 == pytest.approx(v1) and d.pct_change == pytest.approx(pct) and d.mod_prob < 0.5
        assert (d.new_v2 is None) if v2 is None else d.new_v2 == pytest.approx(v2)
        assert d.orig_v1 == x[f1]
    assert {"low", "single", "dual"} <= kinds


def test_statements(cohort):
    got = {r.row_id: r for r in cf.find(cohort, scorer).collect()}
    for r in got.values():
        assert r.disclaimer == fixed.WHAT_IF_DISCLAIMER
        if r.flipped:
            assert "below the 50% threshold" in r.statement and r.details.f1 in r.statement
        elif r.initial_prob <= 0.5:
            assert r.statement.startswith("Patient is already predicted as low-risk (predicted risk: ")
        else:
            assert r.statement == ("No simple counterfactual modification in ['chol', 'trestbps', 'thalach', 'oldpeak'] "
                                   "was sufficient to flip prediction below 50%.")


def test_single_stage_only_and_other_features(cohort):
    only = cf.find(cohort, scorer, dual_steps=0)
    assert only.where("details.type = 'dual'").count() == 0
    one = cf.find(cohort, scorer, features=["oldpeak"]).collect()
    assert all(r.details.f1 == "oldpeak" for r in one if r.flipped)


def test_candidates_and_fallback(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([.2, .6, .9, .51, .85, .7, .8])], "row_id int, p double")
    assert sorted(r.row_id for r in cf.candidates(df, "p").collect()) == [1, 3, 4, 5]
    assert sorted(r.row_id for r in cf.candidates(df.where("p > 0.85 or p < 0.5"), "p").collect()) == [0, 2]


def test_text_sink(spark, cohort, tmp_path):
    found = cf.find(cohort.where("row_id < 3"), scorer)
    sinks.write_what_if(found, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert text.startswith("DISCLAIMER:") and "=" * 80 in text
    assert [f"PATIENT INDEX: {i}" in text for i in range(4)] == [True, True, True, False]


def test_report_keeps_the_order_of_rows(spark, tmp_path):
    from riskweave.sources import sinks

    found = spark.createDataFrame([(10, "x"), (2, "z"), (9, "y")], "row_id long, statement string")
    sinks.write_what_if(found, str(tmp_path / "r"))
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect()).split("\n")
    assert [x for x in lines if x.startswith("PATIENT")] == [f"PATIENT INDEX: {i}" for i in (2, 9, 10)]


def test_percent_ties_go_to_even(spark):
    from riskweave.functions import columns as C

    values = [12.25, 12.35, 12.75, 0.05, 0.15, 99.95, 1e-9, 50.0, -0.25, 33.349999999999994]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(F.format_string("%.1f", C.tie_even("v"))).collect()]
    assert got == [f"{v:.1f}" for v in values]
