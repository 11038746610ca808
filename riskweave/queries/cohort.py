"""Cleaning, union, harmonising, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import cleaning, harmonize, missingness
from riskweave.queries.base import (
    COHORT_CTE, EVENTS_AS_TEXT, LINEITEM_AS_COHORT, ORDERS_AS_EXTERNAL,
    clean, query, raw_cohort, raw_events, raw_external, table,
)

_FEATURES = fixed.FEATURE_COLUMNS

_MISSING_ITEMS = ", ".join(
    f"round(count(CASE WHEN {c} IS NULL THEN 1 END) * 100e0 / count(*), 2) AS {c}" for c in _FEATURES
)


@query("missingness_report", f"""WITH {COHORT_CTE}
SELECT source_site, {_MISSING_ITEMS} FROM clean GROUP BY source_site
UNION ALL SELECT 'combined_overall' AS source_site, {_MISSING_ITEMS} FROM clean""")
def missingness_report(spark, sf_dir):
    return missingness.report(clean(spark, sf_dir))


_EVENTS_SQL = EVENTS_AS_TEXT.format(payload="json_extract_string(props, '$.k')")


@query("clean_sentinel", f"""
SELECT row_id, source_site, TRY_CAST(NULLIF(trim(k), '?') AS DOUBLE) AS k, value
FROM (SELECT {_EVENTS_SQL} FROM events)""")
def clean_sentinel(spark, sf_dir):
    return cleaning.numeric(raw_events(spark, sf_dir), ["k", "value"])


@query("zero_as_missing", f"""WITH {COHORT_CTE}
SELECT row_id, source_site, chol, trestbps, thalach FROM clean""")
def zero_as_missing(spark, sf_dir):
    raw = raw_cohort(spark, sf_dir).select("row_id", "source_site", *fixed.ZERO_IS_MISSING)
    return cleaning.zeros_to_missing(cleaning.numeric(raw, fixed.ZERO_IS_MISSING))


@query("multi_site_union", f"""WITH {COHORT_CTE}
SELECT source_site, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_positive,
       count(chol) AS n_chol, count(ca) AS n_ca, round(avg(age), 6) AS mean_age
FROM clean GROUP BY source_site""")
def multi_site_union(spark, sf_dir):
    """Each site scanned and cleaned on its own, then united by name, as with one
    file per site."""
    lines = raw_cohort(spark, sf_dir)
    sites = [
        cleaning.clean_site(lines.where(F.col("source_site") == s).drop("source_site"), s) for s in fixed.SITES
    ]
    cohort = reduce(DataFrame.unionByName, sites)
    return cohort.groupBy("source_site").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("target").cast("long").alias("n_positive"),
        F.count("chol").alias("n_chol"), F.count("ca").alias("n_ca"), F.round(F.avg("age"), 6).alias("mean_age"),
    )


@query("binarize_target", f"""WITH raw AS (SELECT {LINEITEM_AS_COHORT} FROM lineitem)
SELECT row_id, CASE WHEN TRY_CAST(target AS DOUBLE) > 0 THEN 1 ELSE 0 END AS target FROM raw""")
def binarize_target(spark, sf_dir):
    raw = cleaning.numeric(raw_cohort(spark, sf_dir).select("row_id", "target"), ["target"])
    return raw.withColumn("target", C.binarize("target"))


@query("site_target_counts", f"""WITH {COHORT_CTE}
SELECT source_site, target, count(*) AS n FROM clean GROUP BY source_site, target""")
def site_target_counts(spark, sf_dir):
    return missingness.value_counts(clean(spark, sf_dir), ["source_site", "target"])


_HARMONIZED_SQL = f"""
  SELECT 'cohort' AS origin, CAST(row_id AS STRING) AS row_id, age, sex, trestbps AS sysBP, chol AS totChol,
         fbs AS diabetes, target FROM clean
  UNION ALL
  SELECT 'external', CAST(row_id AS STRING), CAST(age AS DOUBLE), CAST(male AS DOUBLE), sysBP,
         TRY_CAST(NULLIF(totChol, '?') AS DOUBLE),
         coalesce(TRY_CAST(NULLIF(diabetes, '?') AS DOUBLE), 0e0), TenYearCHD
  FROM (SELECT {ORDERS_AS_EXTERNAL} FROM orders)"""


def harmonized(spark, sf_dir):
    cohort = harmonize.from_cohort(raw_cohort(spark, sf_dir), keep=["row_id"])
    external = harmonize.from_external(raw_external(spark, sf_dir), keep=["row_id"])
    return cohort.withColumn("origin", F.lit("cohort")).unionByName(
        external.withColumns({"origin": F.lit("external"), "row_id": F.col("row_id").cast("string")})
    )


@query("harmonize_union", f"WITH {COHORT_CTE} {_HARMONIZED_SQL}")
def harmonize_union(spark, sf_dir):
    return harmonized(spark, sf_dir)


@query("account_harmonize", """
SELECT 'customer' AS origin, c_custkey AS row_id, CAST(c_nationkey AS INTEGER) AS nationkey,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS acctbal FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, CAST(s_nationkey AS INTEGER), s_acctbal FROM supplier""")
def account_harmonize(spark, sf_dir):
    """Two account tables onto shared names; impossible balances of the less
    trusted source become missing, its extra column is dropped."""
    customers = table(spark, sf_dir, "customer").withColumnsRenamed(
        {"c_custkey": "row_id", "c_nationkey": "nationkey", "c_acctbal": "acctbal"}
    ).withColumn("acctbal", F.when(F.col("acctbal") < 0, None).otherwise(F.col("acctbal")))
    suppliers = table(spark, sf_dir, "supplier").withColumnsRenamed(
        {"s_suppkey": "row_id", "s_nationkey": "nationkey", "s_acctbal": "acctbal"}
    )
    shared = ["row_id", "nationkey", "acctbal"]
    return customers.select(F.lit("customer").alias("origin"), *shared).unionByName(
        suppliers.select(F.lit("supplier").alias("origin"), *shared)
    )


@query("complete_columns", f"""WITH {COHORT_CTE}
SELECT row_id, age, sex, cp, trestbps, CAST(NULL AS DOUBLE) AS chol, fbs, restecg, thalach, exang, oldpeak,
       slope, ca, CAST(NULL AS DOUBLE) AS thal FROM clean""")
def complete_columns(spark, sf_dir):
    """Inputs with two columns missing and one unknown column, completed."""
    partial = clean(spark, sf_dir).drop("chol", "thal").withColumn("unknown", F.lit(1))
    return cleaning.complete(partial, keep=["row_id"])


_DOMAIN_ARMS = " UNION ALL ".join(
    f"""SELECT source_site, '{c}' AS feature,
    count(CASE WHEN {c} BETWEEN {lo}e0 AND {hi}e0 THEN 1 END) AS n_valid,
    count(CASE WHEN {c} < {lo}e0 OR {c} > {hi}e0 THEN 1 END) AS n_invalid,
    count(CASE WHEN {c} IS NULL THEN 1 END) AS n_missing FROM clean GROUP BY source_site"""
    for c, (lo, hi) in fixed.DOMAIN_BOUNDS.items()
)


@query("domain_check", f"WITH {COHORT_CTE} {_DOMAIN_ARMS}")
def domain_check(spark, sf_dir):
    return cleaning.domain_report(clean(spark, sf_dir), keys=["source_site"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _label_case(column: str, by_code: dict[float, str]) -> str:
    arms = " ".join(f"WHEN {column} = {code} THEN {_quoted(label)}" for code, label in by_code.items())
    return f"CASE {arms} END"


@query("code_labels", f"""WITH {COHORT_CTE}
SELECT row_id, sex, cp, slope,
       CASE WHEN ca BETWEEN 0 AND 3 THEN ca END AS ca, CASE WHEN thal IN (3, 6, 7) THEN thal END AS thal
FROM clean""")
def code_labels(spark, sf_dir):
    """Codes shown as form labels, then decoded again with the code tables."""
    names = ["sex", "cp", "slope", "ca", "thal"]
    shown = clean(spark, sf_dir).select("row_id", *[
        F.expr(_label_case(n, {v: k for k, v in fixed.CODE_TABLE[n].items()})).alias(n) for n in names
    ])
    return cleaning.code_labels(shown)
