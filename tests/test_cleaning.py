import re

import pytest
from pyspark.sql import functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import cleaning, harmonize, missingness
from riskweave.sources import sinks, sites


def column(df, name):
    return [r[name] for r in df.collect()]


def test_sentinel_and_binarise(spark):
    df = spark.createDataFrame([("0.0", "6.0", 0.0), ("?", "3.0", 2.0), ("0.0", "?", 1.0)], "ca string, thal string, target double")
    out = cleaning.clean_site(df, "cleveland")
    assert column(out, "target") == [0, 1, 1]
    assert column(out, "ca") == [0.0, None, 0.0]
    assert column(out, "thal") == [6.0, 3.0, None]


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([(t,) for t in ["1.5", " 2 ", "x", "", "NaN", "1.5d", "2F", "0x10", "1e3", "-4", "?", None]], "c string")
    assert column(df.select(C.to_number(C.drop_token("c")).alias("c")), "c") == [
        1.5, 2.0, None, None, None, None, None, None, 1000.0, -4.0, None, None]


def test_number_texts_at_the_edges(spark):
    texts = ["1.5d ", " 1.5D", "1.5d\n", "1.5d \n", "1.5d\t", "-nan", "+NaN", "inf", " -Infinity ", "\t7\n", "+0X1p3", "  ?  ", "??", ".5f\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    old = F.trim(C.drop_token("c"))  # the definition, step by step
    old = C.drop_nan(F.when(~old.rlike("(?i)^[+-]?0x|[0-9.][df]$"), old.try_cast("double")))
    rows = df.select("c", old.alias("old"), C.to_number("c", "?").alias("new"), C.to_number(C.drop_token("c")).alias("apart")).collect()
    assert [(r.c, r.new, r.apart) for r in rows] == [(r.c, r.old, r.old) for r in rows]
    assert [r.new for r in rows][:4] == [None, None, None, 1.5]


def test_generated_code_of_a_site_scan_can_be_compiled(spark, tmp_path, capsys):
    """The JVM never compiles a method of more than 8,000 bytes."""
    (tmp_path / "a.csv").write_text(",".join(fixed.COHORT_COLUMNS) + "\n63,1,1,145,0,1,2,150,0,2.3,3,?,6,2\n")
    sites.read_sites(spark, {s: str(tmp_path / "a.csv") for s in fixed.SITES}).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) == len(fixed.SITES) and max(sizes) < 8000


def test_missing_target_is_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (3.0,)], "t double")
    assert column(df.select(C.binarize("t").alias("t")), "t") == [0, 0, 0, 1]


def test_zero_rule_spares_trusted_site_and_other_columns(spark):
    rows = [(s, 0.0, 0.0, 0.0, 0.0, 0.0) for s in fixed.SITES]
    df = spark.createDataFrame(rows, "source_site string, chol double, trestbps double, thalach double, oldpeak double, ca double")
    out = {r.source_site: r for r in cleaning.zeros_to_missing(df).collect()}
    assert (out["cleveland"].chol, out["cleveland"].trestbps, out["cleveland"].thalach) == (0.0, 0.0, 0.0)
    for s in fixed.SITES[1:]:
        assert (out[s].chol, out[s].trestbps, out[s].thalach) == (None, None, None)
    assert all((r.oldpeak, r.ca) == (0.0, 0.0) for r in out.values())


def test_site_files_with_and_without_header(spark, tmp_path):
    head = ",".join(fixed.COHORT_COLUMNS)
    line = "63,1,1,145,0,1,2,150,0,2.3,3,?,6,2"
    (tmp_path / "a.csv").write_text(head + "\n" + line + "\n")
    (tmp_path / "b.csv").write_text(line + "\n")
    with_head = sites.read_site(spark, str(tmp_path / "a.csv"), "cleveland")
    without = sites.read_site(spark, str(tmp_path / "b.csv"), "hungarian", header=False)
    a, b = with_head.collect()[0], without.collect()[0]
    assert (a.chol, a.ca, a.target, a.source_site) == (0.0, None, 1, "cleveland")
    assert (b.chol, b.ca, b.target, b.source_site) == (None, None, 1, "hungarian")
    both = sites.read_sites(spark, {"cleveland": str(tmp_path / "a.csv"), "hungarian": str(tmp_path / "a.csv")})
    assert both.count() == 2 and both.columns == fixed.COHORT_COLUMNS + ["source_site"]
    assert sites.read_trusted_site(spark, str(tmp_path / "a.csv")).collect()[0].chol == 0.0


def test_missingness_report(spark, tmp_path):
    rows = [("a", 1.0, None), ("a", None, None), ("b", 1.0, 2.0), (None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "source_site string, age double, chol double")
    rep = missingness.report(df)
    got = {r.source_site: (r.age, r.chol) for r in rep.collect()}
    assert got == {"a": (50.0, 100.0), "b": (0.0, 0.0), "combined_overall": (25.0, 50.0)}
    sinks.write_csv(rep, str(tmp_path / "report"), single_file=True)
    back = spark.read.option("header", "true").csv(str(tmp_path / "report"))
    assert back.count() == 3 and back.columns == rep.columns


def test_harmonize_both_sides(spark):
    cohort = spark.createDataFrame(
        [("cleveland", 50.0, 1.0, 0.0, 0.0, None, 2.0), ("hungarian", 50.0, 1.0, 0.0, 200.0, 1.0, 0.0)],
        "source_site string, age double, sex double, trestbps double, chol double, fbs double, target double")
    out = harmonize.from_cohort(cohort)
    assert out.columns == fixed.COMMON_COLUMNS
    assert [tuple(r) for r in out.collect()] == [(50.0, 1.0, 0.0, 0.0, None, 1), (50.0, 1.0, None, 200.0, 1.0, 0)]
    ext = spark.createDataFrame([(1, 40, "?", 120.0, None, 1), (0, 41, "180", 130.0, 1, 0)],
                                "male int, age int, totChol string, sysBP double, diabetes int, TenYearCHD int")
    out = harmonize.from_external(ext)
    assert out.columns == fixed.COMMON_COLUMNS
    assert [tuple(r) for r in out.collect()] == [(40.0, 1.0, 120.0, None, 0.0, 1), (41.0, 0.0, 130.0, 180.0, 1.0, 0)]


def test_external_target_must_be_present(spark):
    ext = spark.createDataFrame([(1, 40, "1", 120.0, 0, None)],
                                "male int, age int, totChol string, sysBP double, diabetes int, TenYearCHD int")
    with pytest.raises(Exception, match="target is missing"):
        harmonize.from_external(ext).collect()


def test_complete_and_roles(spark):
    df = spark.createDataFrame([(1, 2.0, "z", 3)], "row_id int, age double, extra string, sex int")
    out = cleaning.complete(df, keep=["row_id"])
    assert out.columns == ["row_id", *fixed.FEATURE_COLUMNS]
    assert out.collect()[0].chol is None
    assert cleaning.infer_roles(df.drop("row_id", "extra")) == (["age"], ["sex"])
    num, cat = cleaning.infer_roles(spark.createDataFrame([(1.0,) * 14], fixed.COHORT_COLUMNS), "declared")
    assert (num, cat) == (fixed.DECLARED_NUMERIC, fixed.DECLARED_CATEGORICAL)
    assert cleaning.drop_roles(df).columns == df.columns


def test_bands_and_labels(spark):
    ages = [45.0, 50.0, 60.0, 65.0, 49.99, 49.995, None]
    df = spark.createDataFrame([(a,) for a in ages], "age double")
    assert column(df.select(C.age_band("age").alias("b")), "b") == ["< 50", "50-60", "50-60", "> 60", "< 50", "50-60", None]
    p = spark.createDataFrame([(x,) for x in (0.2, 0.35, 0.5, 0.65, 0.8)], "p double")
    assert column(p.select(C.risk_level("p").alias("r")), "r") == [
        "Low Risk", "Moderate Risk", "Moderate Risk", "High Risk", "High Risk"]
    s = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "sex double")
    assert column(s.select(C.sex_label("sex").alias("l")), "l") == ["Female (0)", "Male (1)", "2.0", None]


def test_codes_and_domain(spark):
    df = spark.createDataFrame([("Male", "Asymptomatic (4)"), ("Other", "Typical Angina (1)")], "sex string, cp string")
    assert [tuple(r) for r in cleaning.code_labels(df).collect()] == [(1.0, 4.0), (None, 1.0)]
    d = spark.createDataFrame([(19.0,), (20.0,), (90.0,), (None,)], "age double")
    assert [tuple(r) for r in cleaning.domain_report(d).collect()] == [("age", 2, 1, 1)]


def test_grid_and_change(spark):
    df = spark.createDataFrame([(80.0, 0), (80.0, 49), (0.0, 0), (-2.0, 49)], "x double, s int")
    out = df.select(
        C.grid_value("x", C.actionable_bound("chol", "x"), "s", 50).alias("v"),
        C.relative_change(F.col("x") + 1.0, "x").alias("c"),
    ).collect()
    assert [r.v for r in out] == [80.0, 100.0, 0.0, 100.0]
    assert [r.c for r in out] == [1 / 80, 1 / 80, 1.0, -0.5]
