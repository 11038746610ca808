"""Imputation, scaling, encoding, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import fixed
from riskweave.operators import cleaning, folds, prepare
from riskweave.queries.base import COHORT_CTE, FOLD_CTE, FOLDS, SCORED_CTE, SEED, clean, query, scored, table

_NUM = ["trestbps", "chol", "thalach", "oldpeak", "ca"]


@query("median_impute", f"""WITH {COHORT_CTE},
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _NUM)} FROM clean)
SELECT row_id, {", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in _NUM)} FROM clean, m""")
def median_impute(spark, sf_dir):
    df = clean(spark, sf_dir)
    fitted = prepare.fit(df, _NUM)
    out = fitted.transform(df, keep=["row_id"], scale=False)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in _NUM])


_CAT = ["cp", "restecg", "thal"]
_MODE_SQL = ", ".join(
    f"(SELECT {c} FROM clean WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}"
    for c in _CAT
)


@query("mode_impute", f"""WITH {COHORT_CTE}, m AS (SELECT {_MODE_SQL})
SELECT row_id, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _CAT)} FROM clean, m""")
def mode_impute(spark, sf_dir):
    df = clean(spark, sf_dir)
    stats = prepare.fit(df, [], _CAT, one_hot=False).stats[None]
    return df.select("row_id", *[F.coalesce(c, F.lit(stats[c].fill)).alias(c) for c in _CAT])


@query("standard_scale", f"""WITH {COHORT_CTE},
m AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in _NUM)} FROM clean),
f AS (SELECT row_id, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _NUM)} FROM clean, m),
s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS s_{c}" for c in _NUM)} FROM f)
SELECT row_id, {", ".join(f"round(({c} - a_{c}) / s_{c}, 6) + 0e0 AS {c}" for c in _NUM)} FROM f, s""")
def standard_scale(spark, sf_dir):
    df = clean(spark, sf_dir)
    out = prepare.fit(df, _NUM).transform(df, keep=["row_id"])
    return out.select("row_id", *[(F.round(c, 6) + 0.0).alias(c) for c in _NUM])


_HOT = {"cp": [1, 2, 3, 4], "slope": [1, 2, 3]}
_HOT_SQL = ", ".join(
    f"CASE WHEN {c} = {v} THEN 1e0 ELSE 0e0 END AS {c}_{v}" for c, vs in _HOT.items() for v in vs
)


@query("one_hot", f"WITH {COHORT_CTE} SELECT row_id, {_HOT_SQL} FROM clean")
def one_hot(spark, sf_dir):
    df = clean(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in _HOT})
    numeric, categorical = cleaning.infer_roles(df.select(*_HOT))
    return prepare.fit(df, numeric, categorical).transform(df, keep=["row_id"])


_FOLD_NUM = ["chol", "trestbps", "oldpeak"]
_FOLD_MED = ", ".join(f"median({c}) AS m_{c}" for c in _FOLD_NUM)


@query("fold_fit_transform", f"""WITH {FOLD_CTE},
k AS (SELECT DISTINCT fold AS f FROM folded),
m AS (SELECT f, {_FOLD_MED} FROM k JOIN folded ON fold <> f GROUP BY f),
t AS (SELECT m.f, {", ".join(f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in _FOLD_NUM)}
      FROM m JOIN folded ON fold <> m.f GROUP BY m.f)
SELECT row_id, fold, {", ".join(f"round((coalesce({c}, m_{c}) - a_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END, 6) + 0e0 AS {c}" for c in _FOLD_NUM)}
FROM folded JOIN m ON m.f = fold JOIN t ON t.f = fold""")
def fold_fit_transform(spark, sf_dir):
    """Every row prepared with statistics of the other folds only."""
    df = folds.stratified(clean(spark, sf_dir), "row_id", "target", FOLDS, SEED)
    fitted = prepare.fit(df, _FOLD_NUM, fold_col="fold", k=FOLDS)
    out = fitted.transform_folds(df, keep=["row_id", "fold"])
    return out.select("row_id", "fold", *[(F.round(c, 6) + 0.0).alias(c) for c in _FOLD_NUM])


@query("fold_statistics", f"""WITH {FOLD_CTE},
k AS (SELECT DISTINCT fold AS f FROM folded),
m AS (SELECT f, {_FOLD_MED} FROM k JOIN folded ON fold <> f GROUP BY f)
{" UNION ALL ".join(f'''SELECT m.f AS fold, '{c}' AS feature, round(any_value(m_{c}), 6) AS fill,
  round(avg(coalesce({c}, m_{c})), 6) AS mean, round(stddev_pop(coalesce({c}, m_{c})), 6) AS std
  FROM m JOIN folded ON fold <> m.f GROUP BY m.f''' for c in _FOLD_NUM)}""")
def fold_statistics(spark, sf_dir):
    df = folds.stratified(clean(spark, sf_dir), "row_id", "target", FOLDS, SEED)
    fitted = prepare.fit(df, _FOLD_NUM, fold_col="fold", k=FOLDS)
    return fitted.to_frame(spark).select(
        "fold", "feature", *[F.round(c, 6).alias(c) for c in ("fill", "mean", "std")]
    )


@query("drop_all_missing", f"""WITH {COHORT_CTE}, m AS (SELECT median(age) AS m_age FROM clean)
SELECT row_id, round(coalesce(age, m_age), 6) AS age FROM clean, m""")
def drop_all_missing(spark, sf_dir):
    """A feature without any value when fitted is left out of the result."""
    df = clean(spark, sf_dir).select("row_id", "age").withColumn("empty", F.lit(None).cast("double"))
    out = prepare.fit(df, ["age", "empty"]).transform(df, keep=["row_id"], scale=False)
    return out.withColumn("age", F.round("age", 6))


@query("stratified_folds", f"WITH {FOLD_CTE} SELECT row_id, y_true, fold FROM folded")
def stratified_folds(spark, sf_dir):
    df = clean(spark, sf_dir).select("row_id", F.col("target").alias("y_true"))
    return folds.stratified(df, "row_id", "y_true", FOLDS, SEED)


@query("calib_split", f"""WITH {SCORED_CTE},
c AS (SELECT y_true, count(*) AS n FROM scored GROUP BY y_true),
t AS (SELECT y_true, n, ceil(0.25e0 * sum(n) OVER ()) AS want,
             ceil(0.25e0 * sum(n) OVER ()) * n / sum(n) OVER () AS exact FROM c),
q AS (SELECT y_true, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, y_true)
             <= want - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM t),
r AS (SELECT row_id, y_true, row_number() OVER (PARTITION BY y_true
             ORDER BY md5(row_id || '|' || '{SEED}'), row_id) AS k FROM scored)
SELECT row_id, r.y_true, CASE WHEN k <= quota THEN 1 ELSE 0 END AS is_holdout FROM r JOIN q ON r.y_true = q.y_true""")
def calib_split(spark, sf_dir):
    df = clean(spark, sf_dir).select("row_id", F.col("target").alias("y_true"))
    return folds.holdout(df, "row_id", "y_true", 0.25, SEED)


@query("imbalanced_folds", f"""
SELECT l.doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic
       ORDER BY md5(CAST(l.doc_id AS STRING) || '|' || '{SEED}'), l.doc_id) - 1) % {FOLDS} AS INTEGER) AS fold
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def imbalanced_folds(spark, sf_dir):
    """Folds over a cohort with few positives; the text itself is never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    cohort = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "toxic")
    return folds.stratified(cohort, "doc_id", "toxic", FOLDS, SEED)
