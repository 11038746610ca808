"""File sources and sinks on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import fixed
from riskweave.operators import counterfactual, harmonize, missingness, prepare
from riskweave.queries.base import (
    COHORT_CTE, ORDERS_AS_EXTERNAL, clean, query, raw_cohort, raw_external,
)
from riskweave.queries.cohort import _MISSING_ITEMS
from riskweave.queries.explained import _cf_score
from riskweave.session import work_folder
from riskweave.sources import sinks, sites


def _site_files(spark, sf_dir, header: bool) -> dict[str, str]:
    """The raw cohort as one CSV folder per site, written by one job."""
    folder = work_folder(spark, "sites")
    raw = raw_cohort(spark, sf_dir).select(*fixed.COHORT_COLUMNS, "source_site")
    raw.write.partitionBy("source_site").option("header", str(header).lower()).csv(folder)
    return {s: f"{folder}/source_site={s}" for s in fixed.SITES}


_COHORT_ITEMS = ", ".join(fixed.COHORT_COLUMNS)


@query("csv_sites", f"WITH {COHORT_CTE} SELECT {_COHORT_ITEMS}, source_site FROM clean")
def csv_sites(spark, sf_dir):
    """Sites scanned from headered CSV, cleaned, tagged and united."""
    return sites.read_sites(spark, _site_files(spark, sf_dir, header=True))


@query("csv_trusted_site", f"WITH {COHORT_CTE} SELECT {_COHORT_ITEMS}, source_site FROM clean WHERE source_site = 'cleveland'")
def csv_trusted_site(spark, sf_dir):
    """The trusted site from header-less CSV; its zeros are measurements."""
    return sites.read_trusted_site(spark, _site_files(spark, sf_dir, header=False)["cleveland"], header=False)


_EXTERNAL_SQL = f"""SELECT CAST(age AS DOUBLE) AS age, CAST(male AS DOUBLE) AS sex, sysBP,
  TRY_CAST(NULLIF(totChol, '?') AS DOUBLE) AS totChol,
  coalesce(TRY_CAST(NULLIF(diabetes, '?') AS DOUBLE), 0e0) AS diabetes, TenYearCHD AS target
  FROM (SELECT {ORDERS_AS_EXTERNAL} FROM orders)"""


@query("csv_external", _EXTERNAL_SQL)
def csv_external(spark, sf_dir):
    """The external cohort scanned from CSV and harmonised."""
    folder = work_folder(spark, "external")
    raw_external(spark, sf_dir).drop("row_id").write.option("header", "true").csv(folder)
    return harmonize.from_external(sites.read_external(spark, folder))


@query("missingness_csv", f"""WITH {COHORT_CTE}
SELECT source_site, {_MISSING_ITEMS} FROM clean GROUP BY source_site
UNION ALL SELECT 'combined_overall', {_MISSING_ITEMS} FROM clean""")
def missingness_csv(spark, sf_dir):
    """The missing-value report through its CSV sink."""
    folder = work_folder(spark, "missingness")
    report = missingness.report(clean(spark, sf_dir))
    sinks.write_csv(report, folder, single_file=True)
    return spark.read.schema(report.schema).option("header", "true").csv(folder)


@query("what_if_text")
def what_if_text(spark, sf_dir):
    """Statements of the candidate rows through the text sink."""
    folder = work_folder(spark, "what-if")
    picked = counterfactual.candidates(_cf_score(clean(spark, sf_dir), "p"), "p")
    sinks.write_what_if(counterfactual.find(picked, _cf_score), folder)
    return spark.read.text(folder)


_FIT = fixed.COMMON_FEATURES


@query("harmonized_prepare", f"""WITH {COHORT_CTE},
train AS (SELECT age, sex, trestbps AS sysBP, chol AS totChol, fbs AS diabetes FROM clean),
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _FIT)} FROM train),
f AS (SELECT {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _FIT)} FROM train, m),
s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _FIT)} FROM f),
ext AS (SELECT row_id, CAST(age AS DOUBLE) AS age, CAST(male AS DOUBLE) AS sex, sysBP,
  TRY_CAST(NULLIF(totChol, '?') AS DOUBLE) AS totChol, coalesce(TRY_CAST(NULLIF(diabetes, '?') AS DOUBLE), 0e0) AS diabetes
  FROM (SELECT {ORDERS_AS_EXTERNAL} FROM orders))
SELECT row_id, {", ".join(f"round((coalesce({c}, m_{c}) - a_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END, 6) + 0e0 AS {c}" for c in _FIT)}
FROM ext, m, s""")
def harmonized_prepare(spark, sf_dir):
    """Statistics of the whole cohort in the common schema, applied to the
    external cohort."""
    fitted = prepare.fit_harmonized(harmonize.from_cohort(raw_cohort(spark, sf_dir)))
    external = harmonize.from_external(raw_external(spark, sf_dir), keep=["row_id"])
    out = fitted.transform(external, keep=["row_id"])
    return out.select("row_id", *[(F.round(c, 6) + 0.0).alias(c) for c in _FIT])
