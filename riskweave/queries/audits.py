"""Metrics, calibration, subgroup performance, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import agreement, calibration, fairness, metrics, ranks
from riskweave.queries.base import (
    FOLD_CTE, SCORED_CTE, oof, oof_cte, query, scored, table,
)
from riskweave.operators import folds as fold_ops
from riskweave.queries.base import FOLDS, SEED

_CONFUSION = """count(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 END) AS tn,
  count(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 END) AS fp,
  count(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 END) AS fn,
  count(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 END) AS tp"""


def _rates_sql(keys: str, source: str) -> str:
    """Rates over a table with keys and tn, fp, fn, tp."""
    return f"""SELECT {keys} tn, fp, fn, tp, tn + fp + fn + tp AS n,
  round(CAST(tp + tn AS DOUBLE) / (tn + fp + fn + tp), 9) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 9) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 9) AS f1,
  round(CASE WHEN tn + fp = 0 THEN NULL ELSE CAST(tn AS DOUBLE) / (tn + fp) END, 9) AS specificity
  FROM {source}"""


def rank_cte(keys: list[str], source: str, label: str = "y_true", score: str = "y_prob") -> str:
    """CTEs ending in ``ranked(keys, roc_auc, pr_auc)`` by cumulative counts."""
    by = ", ".join(keys)
    head = by + "," if keys else ""
    part = f"PARTITION BY {by}" if keys else ""
    group = f"GROUP BY {by}" if keys else ""
    return f"""
per_score AS (SELECT {head} {score} AS s, CAST(sum({label}) AS DOUBLE) AS pos, CAST(sum(1 - {label}) AS DOUBLE) AS neg
  FROM {source} GROUP BY {head} {score}),
cum AS (SELECT {head} s, pos, neg,
  sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER ({part}) AS p_all, sum(neg) OVER ({part}) AS n_all
  FROM per_score WINDOW w AS ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT {head} s, pos, neg, tp, fp, p_all, n_all, tp / (tp + fp) AS prec,
  coalesce(lag(tp / (tp + fp)) OVER ({part} ORDER BY s DESC), 1e0) AS prec0 FROM cum),
ranked AS (SELECT {head}
  round(CASE WHEN max(p_all) > 0 AND max(n_all) > 0
    THEN sum(pos * (n_all - fp + neg / 2e0)) / (max(p_all) * max(n_all)) END, 9) AS roc_auc,
  round(CASE WHEN max(p_all) > 0 AND max(n_all) > 0
    THEN sum(pos / p_all * (prec + prec0) / 2e0) END, 9) AS pr_auc
  FROM pts {group})"""


def _r(*names, digits: int = 9):
    return [F.round(n, digits).alias(n) for n in names]


_RATES = ["accuracy", "precision", "recall", "f1", "specificity"]


@query("confusion", f"WITH {oof_cte()} SELECT model, {_CONFUSION} FROM oof GROUP BY model")
def confusion(spark, sf_dir):
    return metrics.confusion(oof(spark, sf_dir), ["model"])


@query("fold_confusion", f"WITH {oof_cte(True)} SELECT model, fold, {_CONFUSION} FROM oof GROUP BY model, fold")
def fold_confusion(spark, sf_dir):
    return metrics.confusion(oof(spark, sf_dir, with_fold=True), ["model", "fold"])


@query("classification_metrics", f"""WITH {oof_cte()},
c AS (SELECT model, source_site, {_CONFUSION} FROM oof GROUP BY model, source_site)
{_rates_sql("model, source_site,", "c")}""")
def classification_metrics(spark, sf_dir):
    out = metrics.classification(oof(spark, sf_dir, keep=["source_site"]), ["model", "source_site"])
    return out.select("model", "source_site", "tn", "fp", "fn", "tp", "n", *_r(*_RATES))


@query("roc_auc", f"WITH {oof_cte()}, {rank_cte(['model'], 'oof')} SELECT model, roc_auc FROM ranked")
def roc_auc(spark, sf_dir):
    return metrics.rank_metrics(oof(spark, sf_dir), ["model"]).select("model", *_r("roc_auc"))


@query("pr_auc", f"WITH {oof_cte()}, {rank_cte(['model'], 'oof')} SELECT model, pr_auc FROM ranked")
def pr_auc(spark, sf_dir):
    return metrics.rank_metrics(oof(spark, sf_dir), ["model"]).select("model", *_r("pr_auc"))


@query("extended_metrics", f"""WITH {oof_cte()}, {rank_cte(['model'], 'oof')},
c AS (SELECT model, {_CONFUSION}, count(DISTINCT y_pred) = 1 AS is_degenerate FROM oof GROUP BY model),
r AS ({_rates_sql("model, is_degenerate,", "c")})
SELECT r.*, roc_auc, pr_auc FROM r JOIN ranked ON r.model = ranked.model""")
def extended_metrics(spark, sf_dir):
    out = metrics.extended(oof(spark, sf_dir), ["model"])
    return out.select("model", "tn", "fp", "fn", "tp", "n", "is_degenerate", *_r(*_RATES, "roc_auc", "pr_auc"))


# a quality audit of real labels: the score is a fixed function of the document
_DOC_SCORE = "CAST(n_chars % 1000 AS DOUBLE) / 1000e0"
_DOC_CTE = f"""
docs AS (SELECT lang, source, quality AS y_true, {_DOC_SCORE} AS y_prob,
  CASE WHEN {_DOC_SCORE} > 0.5e0 THEN 1 ELSE 0 END AS y_pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _doc_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    score = (F.col("n_chars") % 1000).cast("double") / 1000.0
    return joined.select(
        "lang", "source", F.col("quality").alias("y_true"), score.alias("y_prob"),
        agreement.label_of(score).alias("y_pred"),
    )


@query("small_group_auc", f"""WITH {_DOC_CTE}, {rank_cte(['lang', 'source'], 'docs')}
SELECT lang, source, roc_auc, pr_auc FROM ranked""")
def small_group_auc(spark, sf_dir):
    """Many small groups, some with one class only: their AUC is NULL."""
    out = metrics.rank_metrics(_doc_audit(spark, sf_dir), ["lang", "source"])
    return out.select("lang", "source", *_r("roc_auc", "pr_auc"))


@query("brier", f"""WITH {oof_cte()}
SELECT model, round(avg((y_prob - y_true) * (y_prob - y_true)), 9) AS brier FROM oof GROUP BY model""")
def brier(spark, sf_dir):
    return calibration.brier(oof(spark, sf_dir), ["model"]).select("model", *_r("brier"))


def _bin_sql(score: str, op: str) -> str:
    return " + ".join(f"CASE WHEN {score} {op} {i}e0 * 0.1e0 THEN 1 ELSE 0 END" for i in range(1, 10))


_ECE_SQL = """
b AS (SELECT {keys}, {bin} AS bin, count(*) AS n, avg(CAST(y_true AS DOUBLE)) AS acc, avg(y_prob) AS conf,
  sum((y_prob - y_true) * (y_prob - y_true)) AS sq FROM {source} GROUP BY ALL)"""


@query("ece", f"""WITH {oof_cte()}, {_ECE_SQL.format(keys='model', bin=_bin_sql('y_prob', '>='), source='oof')}
SELECT model, round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b GROUP BY model""")
def ece(spark, sf_dir):
    return calibration.ece(oof(spark, sf_dir), ["model"]).select("model", *_r("ece"))


@query("ece_on_edges", f"""WITH {_DOC_CTE}, e AS (SELECT lang, y_true, floor(y_prob * 10e0) / 10e0 AS y_prob FROM docs),
{_ECE_SQL.format(keys='lang', bin=_bin_sql('y_prob', '>='), source='e')}
SELECT lang, CAST(bin AS INTEGER) AS bin, n, round(acc, 9) AS fraction_positive FROM b""")
def ece_on_edges(spark, sf_dir):
    """Scores that sit exactly on bin edges, by bin."""
    docs = _doc_audit(spark, sf_dir).withColumn("y_prob", F.floor(F.col("y_prob") * 10.0) / 10.0)
    binned = docs.groupBy("lang", C.bin_left_closed("y_prob", 10).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("y_true"), 9).alias("fraction_positive")
    )
    return binned


@query("reliability_curve", f"""WITH {oof_cte()}
SELECT model, CAST({_bin_sql('y_prob', '>')} AS INTEGER) AS bin, count(*) AS n, round(avg(y_prob), 9) AS mean_predicted,
  round(avg(CAST(y_true AS DOUBLE)), 9) AS fraction_positive
FROM oof WHERE y_prob BETWEEN 0 AND 1 GROUP BY ALL""")
def reliability_curve(spark, sf_dir):
    out = calibration.reliability_curve(oof(spark, sf_dir), ["model"])
    return out.select("model", "bin", "n", *_r("mean_predicted", "fraction_positive"))


_METHOD_ARMS = " UNION ALL ".join(
    f"SELECT model, '{m}' AS method, y_true, {c} AS y_prob FROM oof"
    for m, c in (("uncalibrated", "y_prob"), ("platt", "y_prob_platt"), ("isotonic", "y_prob_iso"))
)


@query("calibration_table", f"""WITH {oof_cte()}, m AS ({_METHOD_ARMS}),
{_ECE_SQL.format(keys='model, method', bin=_bin_sql('y_prob', '>='), source='m')}
SELECT model, method, CAST(sum(n) AS BIGINT) AS n, round(sum(sq) / sum(n), 9) AS brier,
  round(sum(n * abs(acc - conf)) / sum(n), 9) AS ece FROM b GROUP BY model, method""")
def calibration_table(spark, sf_dir):
    long = calibration.by_method(oof(spark, sf_dir))
    return calibration.table(long, ["model", "method"]).select("model", "method", "n", *_r("brier", "ece"))


# --- subgroups ---------------------------------------------------------------

_BAND = "CASE WHEN age <= 49.99e0 THEN '< 50' WHEN age <= 60e0 THEN '50-60' WHEN age IS NOT NULL THEN '> 60' END"
_SEX = "CASE WHEN sex = 0 THEN 'Female (0)' WHEN sex = 1 THEN 'Male (1)' ELSE CAST(sex AS STRING) END"


@query("age_bands", f"WITH {SCORED_CTE} SELECT row_id, {_BAND} AS age_band, {_SEX} AS sex_label FROM scored")
def age_bands(spark, sf_dir):
    return fairness.with_groups(scored(spark, sf_dir)).select("row_id", "age_band", "sex_label")


def _subgroup_sql(keys: list[str], source: str, score: str = "y_prob") -> str:
    by = ", ".join(keys)
    on = " AND ".join(f"r.{k} = ranked.{k}" for k in keys)
    return f"""{rank_cte(keys, source, score=score)},
c AS (SELECT {by}, {_CONFUSION} FROM {source} GROUP BY {by}),
r AS ({_rates_sql(by + ',', 'c')})
SELECT {", ".join("r." + k for k in keys)}, n AS sample_size, round((tp + fn) * 100e0 / n, 9) AS disease_prevalence,
  accuracy, recall, precision, specificity, f1 AS f1_score, roc_auc FROM r JOIN ranked ON {on}"""


_SHAPE = ["disease_prevalence", "accuracy", "recall", "precision", "specificity", "f1_score", "roc_auc"]


@query("subgroup_metrics", f"""WITH {_DOC_CTE}, g AS (SELECT *, lang AS subgroup FROM docs),
{_subgroup_sql(['subgroup'], 'g')}""")
def subgroup_metrics(spark, sf_dir):
    out = fairness.subgroups(_doc_audit(spark, sf_dir), "lang")
    return out.select("subgroup", "sample_size", *_r(*_SHAPE))


@query("segment_metrics", f"""WITH g AS (
  SELECT r_name AS region, c_mktsegment AS segment,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true, o_totalprice / 500000e0 AS y_prob,
    CASE WHEN o_totalprice / 500000e0 > 0.5e0 THEN 1 ELSE 0 END AS y_pred
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
{_subgroup_sql(['region', 'segment'], 'g')}""")
def segment_metrics(spark, sf_dir):
    """Attributes brought to scored orders by joins, then region by segment.

    No join side is forced: region and nation are small enough for Spark to
    send around by their size on disk, customer is joined the way its size asks.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    score = F.col("o_totalprice") / 500000.0
    rows = joined.select(
        F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        score.alias("y_prob"), agreement.label_of(score).alias("y_pred"),
    )
    out = fairness._shape(metrics.extended(rows, ["region", "segment"]), ["region", "segment"])
    return out.select("region", "segment", "sample_size", *_r(*_SHAPE))


_DIMS = {"sex_label": _SEX, "age_band": _BAND, "source_site": "source_site"}
_DIM_ARMS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {e} AS subgroup, y_true, y_pred, ensemble AS y_prob FROM scored"
    for d, e in _DIMS.items()
)


@query("fairness_grouping_sets", f"""WITH {SCORED_CTE}, g AS ({_DIM_ARMS}),
{_subgroup_sql(['dimension', 'subgroup'], 'g')}""")
def fairness_grouping_sets(spark, sf_dir):
    df = fairness.with_groups(scored(spark, sf_dir))
    out = fairness.breakdown(df, score="ensemble")
    return out.select("dimension", "subgroup", "sample_size", *_r(*_SHAPE))


# --- agreement ---------------------------------------------------------------

_STD = """sqrt(((random_forest - m) * (random_forest - m) + (xgboost - m) * (xgboost - m)
  + (adaboost - m) * (adaboost - m)) / 3e0)"""
_LEVEL = ("CASE WHEN std_dev < 0.05e0 THEN 'high agreement' WHEN std_dev < 0.15e0 THEN 'moderate agreement' "
          "ELSE 'low agreement' END")
AGREE_CTE = SCORED_CTE + f""",
a0 AS (SELECT *, (random_forest + xgboost + adaboost) / 3e0 AS m FROM scored),
a1 AS (SELECT *, {_STD} AS std_dev FROM a0),
agreed AS (SELECT row_id AS patient_index, y_true, y_pred, random_forest AS rf_prob, xgboost AS xgb_prob,
  adaboost AS ada_prob, std_dev, {_LEVEL} AS agreement_level,
  CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS is_correct FROM a1)"""
_PCT = "CAST(CAST(round_even({} * 100e0, 0) AS INTEGER) AS STRING)"
FLAG_SQL = f"""'Model agreement: ' || agreement_level || ' — RF: ' || {_PCT.format('rf_prob')}
  || '%, XGBoost: ' || {_PCT.format('xgb_prob')} || '%, AdaBoost: ' || {_PCT.format('ada_prob')} || '%.' ||
  CASE agreement_level WHEN 'high agreement' THEN ' High consensus among base classifiers.'
    WHEN 'moderate agreement' THEN ' Moderate variance among base classifiers.'
    ELSE ' Interpret this prediction with extra caution.' END"""


def _agreed(spark, sf_dir):
    return agreement.analyze(scored(spark, sf_dir))


@query("agreement_scores", f"""WITH {AGREE_CTE}
SELECT patient_index, y_true, y_pred, round(rf_prob, 9) AS rf_prob, round(xgb_prob, 9) AS xgb_prob, ada_prob,
  round(std_dev, 9) AS std_dev, agreement_level, is_correct FROM agreed""")
def agreement_scores(spark, sf_dir):
    return _agreed(spark, sf_dir).drop("flag_string").withColumns(
        {c: F.round(c, 9) for c in ("rf_prob", "xgb_prob", "std_dev")}
    )


@query("agreement_flags", f"WITH {AGREE_CTE} SELECT patient_index, {FLAG_SQL} AS flag_string FROM agreed")
def agreement_flags(spark, sf_dir):
    return _agreed(spark, sf_dir).select("patient_index", "flag_string")


@query("agreement_summary", f"""WITH {AGREE_CTE},
l AS (SELECT * FROM (VALUES (0, 'high agreement'), (1, 'moderate agreement'), (2, 'low agreement')) t(level_order, agreement_level))
SELECT l.level_order, l.agreement_level, count(patient_index) AS sample_size,
  round(count(patient_index) * 100e0 / (SELECT count(*) FROM agreed), 9) AS pct_of_total,
  round(avg(CAST(is_correct AS DOUBLE)), 9) AS accuracy
FROM l LEFT JOIN agreed a ON l.agreement_level = a.agreement_level GROUP BY ALL""")
def agreement_summary(spark, sf_dir):
    out = agreement.summarize(_agreed(spark, sf_dir))
    return out.select("level_order", "agreement_level", "sample_size", *_r("pct_of_total", "accuracy"))


@query("agreement_examples", f"""WITH {AGREE_CTE}
SELECT patient_index, agreement_level, y_true, y_pred FROM agreed
QUALIFY row_number() OVER (PARTITION BY agreement_level ORDER BY patient_index) <= 2""")
def agreement_examples(spark, sf_dir):
    out = agreement.examples(_agreed(spark, sf_dir))
    return out.select("patient_index", "agreement_level", "y_true", "y_pred")


@query("agreement_histogram", f"""WITH {AGREE_CTE},
s AS (SELECT round(std_dev, 9) AS v FROM agreed),
e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20e0 AS w FROM s),
c AS (SELECT CAST(least(floor((v - lo) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM s, e GROUP BY bin),
b AS (SELECT CAST(i AS INTEGER) AS bin FROM range(20) r(i))
SELECT b.bin, coalesce(n, 0) AS n, round(lo + b.bin * w, 12) AS bin_lo, round(lo + (b.bin + 1) * w, 12) AS bin_hi
FROM b LEFT JOIN c ON c.bin = b.bin, e""")
def agreement_histogram(spark, sf_dir):
    rows = _agreed(spark, sf_dir).select(F.round("std_dev", 9).alias("v"))
    return metrics.histogram(rows, "v", 20).select("bin", "n", *_r("bin_lo", "bin_hi", digits=12))


# --- votes and out-of-fold tables --------------------------------------------

@query("soft_vote", f"""WITH {SCORED_CTE} SELECT row_id, round(ensemble, 9) AS ensemble, y_pred FROM scored""")
def soft_vote(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", *_r("ensemble"), "y_pred")


@query("hard_vote", f"""WITH {SCORED_CTE}
SELECT row_id, CASE WHEN 2 * (CASE WHEN random_forest > 0.5e0 THEN 1 ELSE 0 END
  + CASE WHEN xgboost > 0.5e0 THEN 1 ELSE 0 END + CASE WHEN adaboost > 0.5e0 THEN 1 ELSE 0 END) > 3
  THEN 1 ELSE 0 END AS y_vote FROM scored""")
def hard_vote(spark, sf_dir):
    labels = [agreement.label_of(m) for m in fixed.BASE_MODELS]
    return scored(spark, sf_dir).select("row_id", agreement.hard_vote(*labels).alias("y_vote"))


_SUMMARY = ["accuracy", "precision", "recall", "f1", "roc_auc"]


@query("fold_metric_summary", f"""WITH {oof_cte(True)}, {rank_cte(['model', 'fold'], 'oof')},
c AS (SELECT model, fold, {_CONFUSION} FROM oof GROUP BY model, fold),
r AS ({_rates_sql("model, fold,", "c")}),
j AS (SELECT r.*, roc_auc FROM r JOIN ranked ON r.model = ranked.model AND r.fold = ranked.fold)
SELECT model, {", ".join(f"round(avg({m}), 7) AS {m}_mean, round(stddev_pop({m}), 7) AS {m}_std" for m in _SUMMARY)}
FROM j GROUP BY model""")
def fold_metric_summary(spark, sf_dir):
    # the scores do not depend on the folds, nor do good cut points
    cuts = ranks.cut_points(oof(spark, sf_dir), "y_prob")
    per_fold = metrics.extended(oof(spark, sf_dir, with_fold=True), ["model", "fold"], cuts=cuts)
    rounded = per_fold.withColumns({m: F.round(m, 9) for m in _SUMMARY})
    out = metrics.fold_summary(rounded, ["model"], _SUMMARY)
    names = [f"{m}_{s}" for m in _SUMMARY for s in ("mean", "std")]
    return out.select("model", *_r(*names, digits=7))


@query("oof_alignment", f"""WITH {FOLD_CTE}
SELECT row_id, fold, age, sex, source_site, round(random_forest, 9) AS random_forest,
  round(xgboost, 9) AS xgboost, round(adaboost, 9) AS adaboost, round(ensemble, 9) AS ensemble FROM folded""")
def oof_alignment(spark, sf_dir):
    """The long store turned wide per row, then joined to the cohort's attributes
    by key."""
    store = oof(spark, sf_dir, with_fold=True)
    wide = agreement.wide(store, "row_id", extra=["fold"])
    cohort = scored(spark, sf_dir).select("row_id", "age", "sex", "source_site")
    out = cohort.join(wide, "row_id")
    return out.select("row_id", "fold", "age", "sex", "source_site", *_r(*fixed.ALL_MODELS))


@query("risk_levels", f"""WITH {SCORED_CTE}
SELECT row_id, CASE WHEN ensemble < 0.35e0 THEN 'Low Risk' WHEN ensemble < 0.65e0 THEN 'Moderate Risk'
  ELSE 'High Risk' END AS risk_label FROM scored""")
def risk_levels(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", C.risk_level("ensemble").alias("risk_label"))


# --- calibrators -------------------------------------------------------------

_CAL_CTE = SCORED_CTE + ", cal AS (SELECT adaboost AS p, CAST(y_true AS DOUBLE) AS y FROM scored)"


def _newton_ctes(rounds: int, c: float) -> str:
    """Unrolled Newton steps of the penalised logistic fit on distinct scores."""
    out = [f""" g AS (SELECT p, y, CAST(count(*) AS DOUBLE) AS w FROM cal GROUP BY p, y),
k0 AS (SELECT 0e0 AS a, 0e0 AS b)"""]
    for i in range(rounds):
        out.append(f"""
d{i} AS (SELECT sum(w * (y - q) * p) - max(a) / {c}e0 AS ga, sum(w * (y - q)) AS gb,
  sum(w * q * (1e0 - q) * p * p) + 1e0 / {c}e0 AS haa, sum(w * q * (1e0 - q) * p) AS hab, sum(w * q * (1e0 - q)) AS hbb,
  max(a) AS a, max(b) AS b
  FROM (SELECT g.*, a, b, 1e0 / (1e0 + exp(-(a * p + b))) AS q FROM g, k{i})),
k{i + 1} AS (SELECT a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM d{i})""")
    return ",".join(out)


@query("platt", f"""WITH {_CAL_CTE}, {_newton_ctes(10, 100000)}
SELECT round(a, 4) AS slope, round(b, 4) AS intercept FROM k10""")
def platt(spark, sf_dir):
    fitted = calibration.PlattScaler.fit(scored(spark, sf_dir), "y_true", "adaboost")
    return spark.range(1).select(
        F.round(F.lit(fitted.slope), 4).alias("slope"), F.round(F.lit(fitted.intercept), 4).alias("intercept")
    )


@query("platt_apply", f"""WITH {_CAL_CTE}, {_newton_ctes(10, 100000)}
SELECT row_id, round(1e0 / (1e0 + exp(-(a * adaboost + b))), 4) AS y_prob_platt FROM scored, k10""")
def platt_apply(spark, sf_dir):
    df = scored(spark, sf_dir)
    fitted = calibration.PlattScaler.fit(df, "y_true", "adaboost")
    return df.select("row_id", F.round(fitted.column("adaboost"), 4).alias("y_prob_platt"))


@query("isotonic", f"""WITH {_CAL_CTE},
g AS (SELECT p, sum(y) AS sy, CAST(count(*) AS DOUBLE) AS w, row_number() OVER (ORDER BY p) AS k FROM cal GROUP BY p),
c AS (SELECT p, k, sum(sy) OVER (ORDER BY k) AS cy, sum(w) OVER (ORDER BY k) AS cw, sy, w FROM g),
ij AS (SELECT i.k AS i, j.k AS j, (j.cy - i.cy + i.sy) / (j.cw - i.cw + i.w) AS m FROM c i JOIN c j ON i.k <= j.k),
low AS (SELECT i, j AS k, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM ij),
fit AS (SELECT k, max(m) AS v FROM low GROUP BY k)
SELECT row_id, round(v, 9) AS y_prob_iso FROM scored JOIN c ON adaboost = p JOIN fit ON fit.k = c.k""")
def isotonic(spark, sf_dir):
    df = scored(spark, sf_dir)
    fitted = calibration.IsotonicCalibrator.fit(df, "y_true", "adaboost")
    return fitted.transform(df, "adaboost", "y_prob_iso").select("row_id", *_r("y_prob_iso"))
