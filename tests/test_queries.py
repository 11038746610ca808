"""Every query with SQL gives the same rows as the SQL, at the smallest scale."""

import importlib.util
import inspect
from pathlib import Path

import pytest

from riskweave.operators import explain, learners, search
from riskweave.plans import external, nested, stability, train
from riskweave.queries import base, catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
_spec = importlib.util.spec_from_file_location("compare_tool", ROOT / "tools" / "compare.py")
compare_tool = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare_tool)


@pytest.fixture(scope="module")
def duck():
    return compare_tool.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    assert compare_tool.compare(df, duck, catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["surrogate_fit", "cf_statements", "score_report", "adaboost", "tree_attribution"])
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


class Called(Exception):
    pass


@pytest.mark.parametrize("name, owner, function, wanted", [
    ("nested_cv", nested, "out_of_fold", {"outer": 5, "inner": 3, "n_trials": 15, "spaces": None}),
    ("random_search", search, "search", {"k": 3, "n_trials": 20, "space": None}),
    ("external_compare", external, "run", {"outer": 5, "inner": 3, "n_trials": 15, "spaces": None}),
    ("fitted_stability", stability, "evaluate", {"outer": 5, "kw": {}}),
    ("train_score", train, "load_or_train", {"kw": {}}),
    ("adaboost", learners.AdaBoost, "fit", {"params": {"n_estimators": 50, "learning_rate": 1.0}}),
    ("tree_attribution", learners.GradientBoosting, "fit", {"params": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1}}),
    ("surrogate_fit", explain, "surrogate", {"samples": 5000}),
])
def test_fitted_queries_ask_for_the_whole_job(spark, monkeypatch, name, owner, function, wanted):
    of = inspect.signature(getattr(owner, function))

    def stop(*args, **kw):
        bound = of.bind(*args, **kw)
        bound.apply_defaults()
        raise Called({"kw": {}} | dict(bound.arguments) | {"params": getattr(args[0], "params", None)})

    monkeypatch.setattr(owner, function, stop)
    with pytest.raises(Called) as seen:
        catalog.QUERIES[name](spark, SF)
    got = seen.value.args[0]
    assert {k: got[k] for k in wanted} == wanted
    if name == "external_compare":
        sites = base.raw_cohort(spark, SF).groupBy("source_site").count().collect()
        assert got["single"].count() == {r[0]: r[1] for r in sites}["cleveland"]
        assert got["combined"].count() == sum(r[1] for r in sites)
    if name == "surrogate_fit":
        assert got["df"].count() == base.clean(spark, SF).count()
        assert got["df"].where("chol IS NULL OR thalach IS NULL OR trestbps IS NULL").count() == 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
