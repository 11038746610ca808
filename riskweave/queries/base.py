"""Registry of named queries, and the tables they run on.

The given star-schema tables stand in for cohorts.  The adapter projections are
plain SQL that Spark and the checking engine both read, so that they start from
the same rows; everything after that is written twice, as operators here and as
independent SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import agreement, cleaning, folds
from riskweave.session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where the result can be written in SQL."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- adapters: given tables as cohorts ---------------------------------------

# order lines as cohort rows: 13 features, raw target 0-4, site; '?' and other
# bad text in ca, thal and target, zeros for "not measured" in chol and trestbps
LINEITEM_AS_COHORT = """
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
            CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
            CAST(CAST(round(l_extendedprice * 100e0) AS BIGINT) AS STRING)) AS row_id,
  20e0 + l_quantity * 1.4e0 AS age,
  CAST(l_linenumber % 2 AS DOUBLE) AS sex,
  CAST(1 + l_partkey % 4 AS DOUBLE) AS cp,
  CASE WHEN l_tax = 0 THEN 0e0 ELSE 80e0 + l_tax * 1750e0 END AS trestbps,
  CASE WHEN l_discount = 0 THEN 0e0 ELSE 100e0 + l_discount * 5000e0 END AS chol,
  CASE WHEN l_suppkey % 7 = 0 THEN 1e0 ELSE 0e0 END AS fbs,
  CAST(l_suppkey % 3 AS DOUBLE) AS restecg,
  60e0 + l_extendedprice / 660e0 AS thalach,
  CAST(l_orderkey % 2 AS DOUBLE) AS exang,
  CAST(l_partkey % 71 AS DOUBLE) / 10e0 AS oldpeak,
  CAST(1 + l_linenumber % 3 AS DOUBLE) AS slope,
  CASE WHEN l_orderkey % 3 = 0 THEN '?' ELSE CAST(l_partkey % 4 AS STRING) END AS ca,
  CASE l_orderkey % 5 WHEN 0 THEN '?' WHEN 1 THEN 'n/a' WHEN 2 THEN ' 3.0' WHEN 3 THEN '6' ELSE '7.0 ' END AS thal,
  CASE WHEN l_orderkey % 97 = 0 THEN '?'
       WHEN CAST((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31) % 1000 AS DOUBLE)
            < 50e0 + 9e0 * l_quantity + 60e0 * (CAST(l_partkey % 71 AS DOUBLE) / 10e0)
       THEN CAST(1 + l_linenumber % 4 AS STRING) ELSE '0' END AS target,
  CASE WHEN l_returnflag = 'A' THEN 'cleveland' WHEN l_returnflag = 'N' THEN 'hungarian'
       WHEN l_linenumber <= 3 THEN 'switzerland' ELSE 'va_long_beach' END AS source_site
"""

# orders as the external cohort: same meaning, other names, 16 columns
ORDERS_AS_EXTERNAL = """
  o_orderkey AS row_id,
  CAST(o_orderkey % 2 AS INT) AS male,
  CAST(30 + o_custkey % 41 AS INT) AS age,
  CAST(1 + o_orderkey % 4 AS DOUBLE) AS education,
  CAST(o_custkey % 2 AS INT) AS currentSmoker,
  CAST(o_orderkey % 30 AS INT) AS cigsPerDay,
  CAST(o_orderkey % 3 AS DOUBLE) AS BPMeds,
  CAST(o_custkey % 5 AS INT) AS prevalentStroke,
  CAST(o_custkey % 3 AS INT) AS prevalentHyp,
  CASE WHEN o_orderkey % 11 = 0 THEN '?' WHEN o_custkey % 9 = 0 THEN '1' ELSE '0' END AS diabetes,
  CASE WHEN o_orderkey % 13 = 0 THEN '?' ELSE CAST(150 + o_orderkey % 200 AS STRING) END AS totChol,
  90e0 + o_totalprice / 5000e0 AS sysBP,
  CAST(60 + o_orderkey % 50 AS INT) AS diaBP,
  18e0 + CAST(o_custkey % 200 AS DOUBLE) / 10e0 AS BMI,
  CAST(50 + o_orderkey % 60 AS INT) AS heartRate,
  CAST(60 + o_custkey % 120 AS INT) AS glucose,
  CAST(CASE WHEN (o_orderkey * 37 + o_custkey * 11) % 100 < 5 + o_custkey % 41 THEN 1 ELSE 0 END AS INT) AS TenYearCHD
"""

# event payloads as text features of five sources
EVENTS_AS_TEXT = """
  event_id AS row_id, event_type AS source_site,
  CASE WHEN event_id % 10 = 0 THEN '?' WHEN event_id % 10 = 1 THEN 'bad' ELSE {payload} END AS k,
  value
"""


def raw_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem")).selectExpr(*_items(LINEITEM_AS_COHORT))


def raw_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_items(ORDERS_AS_EXTERNAL))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = EVENTS_AS_TEXT.format(payload="get_json_object(props, '$.k')")
    return table(spark, sf_dir, "events").selectExpr(*_items(text))


def _items(text: str) -> list[str]:
    """The select list split at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_cohort(raw_cohort(spark, sf_dir))


# --- closed-form scorers -----------------------------------------------------

def base_probabilities(c: dict) -> dict:
    """Three fixed scoring formulas over feature columns, standing in for fitted
    models where a result is checked against SQL."""
    z = (c["age"] - 20.0) / 70.0
    o = c["oldpeak"] / 7.0
    chol = F.coalesce(c["chol"], F.lit(240.0)) / 600.0
    bps = F.coalesce(c["trestbps"], F.lit(140.0)) / 220.0
    slow = 1.0 - c["thalach"] / 220.0
    return {
        "random_forest": 0.4 * z + 0.3 * o + 0.2 * chol + 0.1 * slow,
        "xgboost": 0.5 * o + 0.3 * z + 0.2 * bps,
        "adaboost": F.floor((0.3 + 0.4 * (0.5 * z + 0.5 * slow)) * 1000.0) / 1000.0,
    }


SCORE_SQL = {
    "random_forest": "0.4e0 * (({age} - 20e0) / 70e0) + 0.3e0 * ({oldpeak} / 7e0)"
                     " + 0.2e0 * (coalesce({chol}, 240e0) / 600e0) + 0.1e0 * (1e0 - {thalach} / 220e0)",
    "xgboost": "0.5e0 * ({oldpeak} / 7e0) + 0.3e0 * (({age} - 20e0) / 70e0)"
               " + 0.2e0 * (coalesce({trestbps}, 140e0) / 220e0)",
    "adaboost": "floor((0.3e0 + 0.4e0 * (0.5e0 * (({age} - 20e0) / 70e0)"
                " + 0.5e0 * (1e0 - {thalach} / 220e0))) * 1000e0) / 1000e0",
}
SCORED_FEATURES = ["age", "oldpeak", "chol", "trestbps", "thalach"]


def score_sql(model: str, **replaced: str) -> str:
    names = {f: f for f in SCORED_FEATURES}
    names.update(replaced)
    return "(" + SCORE_SQL[model].format(**names) + ")"


def feature_map(**replaced) -> dict:
    names = {f: F.col(f) for f in SCORED_FEATURES}
    names.update(replaced)
    return names


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean cohort with three base probabilities, the soft vote and its label."""
    df = clean(spark, sf_dir).withColumns(base_probabilities(feature_map()))
    df = df.withColumn(fixed.ENSEMBLE, agreement.soft_vote(*fixed.BASE_MODELS))
    return df.withColumns({"y_true": F.col("target"), "y_pred": agreement.label_of(fixed.ENSEMBLE)})


FOLDS, SEED = 5, 42


def oof(spark: SparkSession, sf_dir: str, with_fold: bool = False, keep: list[str] = ()) -> DataFrame:
    """The long prediction store: one row per (row, model)."""
    df = scored(spark, sf_dir)
    if with_fold:
        df = folds.stratified(df, "row_id", "y_true", FOLDS, SEED)
    head = ["row_id", *(["fold"] if with_fold else []), "y_true", *keep]
    parts = ", ".join(f"'{m}', `{m}`" for m in fixed.ALL_MODELS)
    long = df.select(*head, F.expr(f"stack({len(fixed.ALL_MODELS)}, {parts}) as (model, y_prob)"))
    return long.withColumns({
        "y_pred": agreement.label_of("y_prob"),
        "y_prob_platt": 0.1 + 0.8 * F.col("y_prob"),
        "y_prob_iso": F.floor(F.col("y_prob") * 20.0) / 20.0,
    })


# --- the same tables in SQL --------------------------------------------------

COHORT_CTE = f"""
raw AS (SELECT {LINEITEM_AS_COHORT} FROM lineitem),
clean AS (
  SELECT row_id, source_site, age, sex, cp,
    CASE WHEN source_site <> 'cleveland' AND trestbps = 0 THEN NULL ELSE trestbps END AS trestbps,
    CASE WHEN source_site <> 'cleveland' AND chol = 0 THEN NULL ELSE chol END AS chol,
    fbs, restecg,
    CASE WHEN source_site <> 'cleveland' AND thalach = 0 THEN NULL ELSE thalach END AS thalach,
    exang, oldpeak, slope,
    TRY_CAST(NULLIF(trim(ca), '?') AS DOUBLE) AS ca,
    TRY_CAST(NULLIF(trim(thal), '?') AS DOUBLE) AS thal,
    CASE WHEN TRY_CAST(NULLIF(trim(target), '?') AS DOUBLE) > 0 THEN 1 ELSE 0 END AS target
  FROM raw)"""

SCORED_CTE = COHORT_CTE + f""",
scored0 AS (
  SELECT *, {score_sql('random_forest')} AS random_forest, {score_sql('xgboost')} AS xgboost,
         {score_sql('adaboost')} AS adaboost
  FROM clean),
scored AS (
  SELECT *, (random_forest + xgboost + adaboost) / 3e0 AS ensemble, target AS y_true,
         CASE WHEN (random_forest + xgboost + adaboost) / 3e0 > 0.5e0 THEN 1 ELSE 0 END AS y_pred
  FROM scored0)"""

FOLD_CTE = SCORED_CTE + f""",
folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY y_true
                  ORDER BY md5(row_id || '|' || '{SEED}'), row_id) - 1) % {FOLDS} AS INTEGER) AS fold
  FROM scored)"""


def oof_cte(with_fold: bool = False) -> str:
    source = "folded" if with_fold else "scored"
    arms = " UNION ALL ".join(
        f"SELECT *, '{m}' AS model, {m} AS y_prob FROM {source}" for m in fixed.ALL_MODELS
    )
    return (FOLD_CTE if with_fold else SCORED_CTE) + f""",
long AS ({arms}),
oof AS (
  SELECT row_id, {'fold,' if with_fold else ''} source_site, age, sex, y_true, model, y_prob,
    CASE WHEN y_prob > 0.5e0 THEN 1 ELSE 0 END AS y_pred,
    0.1e0 + 0.8e0 * y_prob AS y_prob_platt,
    floor(y_prob * 20e0) / 20e0 AS y_prob_iso
  FROM long)"""
