"""Rankings, attributions, surrogates, counterfactuals, scoring, learners."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import agreement, boosting, cleaning, counterfactual, explain, folds, learners, scoring, search, stability, stumps
from riskweave.operators import harmonize, prepare
from riskweave.plans import external as external_plan, nested, stability as stability_plan, train
from riskweave.queries.base import (
    COHORT_CTE, FOLD_CTE, FOLDS, LINEITEM_AS_COHORT, SCORED_CTE, SEED, base_probabilities, clean, feature_map, query, raw_cohort,
    raw_external, score_sql, scored, table, _items,
)
from riskweave.queries.audits import AGREE_CTE, FLAG_SQL
from riskweave.session import work_folder
from riskweave.streaming.scoring import score_stream as run_score_stream

# --- closed-form contributions -----------------------------------------------

# two attribution-like vectors per row; the zero entries tie on purpose
_RANKED = ["age", "oldpeak", "chol", "thalach", "trestbps", "fbs"]
_FIRST = {
    "age": "0.4e0 * ((age - 20e0) / 70e0) - 0.2e0",
    "oldpeak": "0.3e0 * (oldpeak / 7e0) - 0.15e0",
    "chol": "0.2e0 * (coalesce(chol, 240e0) / 600e0) - 0.11e0",
    "thalach": "0.1e0 * (1e0 - thalach / 220e0) - 0.03e0",
    "trestbps": "0e0", "fbs": "0e0",
}
_SECOND = {
    "age": "0.3e0 * ((age - 20e0) / 70e0) - 0.15e0",
    "oldpeak": "0.5e0 * (oldpeak / 7e0) - 0.25e0",
    "chol": "0e0", "thalach": "0.05e0 * (thalach / 220e0)",
    "trestbps": "0.2e0 * (coalesce(trestbps, 140e0) / 220e0) - 0.12e0",
    "fbs": "0e0",
}


def _values(texts: dict[str, str]) -> dict:
    return {f: F.expr(texts[f]) for f in _RANKED}


def _long_sql(name: str, texts: dict[str, str], extra: str = "") -> str:
    arms = " UNION ALL ".join(
        f"SELECT row_id, {extra} {i} AS idx, '{f}' AS feature, {texts[f]} AS v FROM clean" for i, f in enumerate(_RANKED)
    )
    return f"""{name}_long AS ({arms}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, idx DESC) AS k FROM {name}_long)"""


_TWO = f"{COHORT_CTE}, {_long_sql('first', _FIRST)}, {_long_sql('second', _SECOND)}"


def _two_lists(spark, sf_dir, k=len(_RANKED)):
    df = clean(spark, sf_dir)
    return df.select(
        "row_id", explain.top_features(_values(_FIRST), k).alias("a"), explain.top_features(_values(_SECOND), k).alias("b")
    )


@query("topk_attribution", f"""WITH {COHORT_CTE}, {_long_sql('first', _FIRST)}
SELECT row_id, string_agg(feature, ', ' ORDER BY k) AS top_features,
  string_agg(CASE WHEN v > 0 THEN 'increases risk' ELSE 'decreases risk' END, ', ' ORDER BY k) AS impacts,
  round(sum(v), 9) + 0e0 AS top_sum
FROM first WHERE k <= 3 GROUP BY row_id""")
def topk_attribution(spark, sf_dir):
    top = clean(spark, sf_dir).select("row_id", F.slice(explain.ordered_features(_values(_FIRST)), 1, 3).alias("t"))
    return top.select(
        "row_id", F.array_join(F.transform("t", lambda s: s["feature"]), ", ").alias("top_features"),
        F.array_join(F.transform("t", lambda s: C.impact_text(s["value"])), ", ").alias("impacts"),
        (F.round(F.aggregate("t", F.lit(0.0), lambda acc, s: acc + s["value"]), 9) + 0.0).alias("top_sum"),
    )


_IMPORTANCE = f"""imp AS (SELECT grp, idx AS feature_index, feature, round(avg(abs(v)), 9) AS importance
  FROM first_long GROUP BY grp, idx, feature),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY importance DESC, feature_index DESC) - 1 AS INTEGER) AS rank FROM imp)"""


@query("importance_rank", f"""WITH {COHORT_CTE}, {_long_sql('first', _FIRST, 'source_site AS grp,')}, {_IMPORTANCE}
SELECT grp AS source_site, feature, feature_index, importance, rank FROM ranks""")
def importance_rank(spark, sf_dir):
    df = clean(spark, sf_dir).select("source_site", *[v.alias(f) for f, v in _values(_FIRST).items()])
    long = explain.importance(df, _RANKED, ["source_site"]).withColumn("importance", F.round("importance", 9))
    return explain.rank_features(long, ["source_site"])


@query("overlap_at_k", f"""WITH {_TWO}
SELECT a.row_id, count(CASE WHEN a.k <= 3 AND b.k <= 3 THEN 1 END) / 3e0 AS overlap
FROM first a JOIN second b ON a.row_id = b.row_id AND a.feature = b.feature GROUP BY a.row_id""")
def overlap_at_k(spark, sf_dir):
    return _two_lists(spark, sf_dir).select("row_id", C.overlap_ratio("a", "b", 3).alias("overlap"))


_PLACE = ", ".join(f"max(CASE WHEN a.feature = '{f}' THEN a.k END) AS a_{f}, max(CASE WHEN a.feature = '{f}' THEN b.k END) AS b_{f}"
                   for f in _RANKED)
_SIGNS = " + ".join(f"sign((a_{f} - a_{g}) * (b_{f} - b_{g}))" for f, g in combinations(_RANKED, 2))


@query("kendall_tau", f"""WITH {_TWO},
w AS (SELECT a.row_id, {_PLACE} FROM first a JOIN second b ON a.row_id = b.row_id AND a.feature = b.feature GROUP BY a.row_id)
SELECT row_id, round(CAST({_SIGNS} AS DOUBLE) / {math.comb(len(_RANKED), 2)}e0, 9) AS tau FROM w""")
def kendall_tau(spark, sf_dir):
    return _two_lists(spark, sf_dir).select("row_id", F.round(stability.kendall_tau("a", "b"), 9).alias("tau"))


_DECADE = "CAST(floor((age - 20e0) / 14e0) AS INTEGER)"
_PAIRS_SQL = f"""{COHORT_CTE}, {_long_sql('first', _FIRST, _DECADE + ' AS grp,')}, {_IMPORTANCE},
j AS (SELECT a.grp AS fold_a, b.grp AS fold_b, a.feature, a.rank AS ra, b.rank AS rb
  FROM ranks a JOIN ranks b ON a.feature = b.feature AND a.grp < b.grp),
pairs AS (SELECT x.fold_a, x.fold_b,
    round(sum(sign((x.ra - y.ra) * (x.rb - y.rb))) / {math.comb(len(_RANKED), 2)}e0, 9) AS kendall_tau
  FROM j x JOIN j y ON x.fold_a = y.fold_a AND x.fold_b = y.fold_b AND x.feature < y.feature GROUP BY x.fold_a, x.fold_b),
over AS (SELECT fold_a, fold_b, round(count(CASE WHEN ra < 3 AND rb < 3 THEN 1 END) / 3e0, 9) AS overlap_at_k
  FROM j GROUP BY fold_a, fold_b)"""


def _age_group_ranks(spark, sf_dir):
    df = clean(spark, sf_dir).select(
        F.floor((F.col("age") - 20.0) / 14.0).cast("int").alias("fold"),
        *[v.alias(f) for f, v in _values(_FIRST).items()],
    )
    long = explain.importance(df, _RANKED, ["fold"]).withColumn("importance", F.round("importance", 9))
    return explain.rank_features(long, ["fold"])


@query("fold_pairs", f"""WITH {_PAIRS_SQL}
SELECT over.fold_a, over.fold_b, overlap_at_k, kendall_tau FROM over JOIN pairs
  ON over.fold_a = pairs.fold_a AND over.fold_b = pairs.fold_b""")
def fold_pairs(spark, sf_dir):
    out = stability.fold_pairs(_age_group_ranks(spark, sf_dir), k=3)
    return out.select("fold_a", "fold_b", *[F.round(c, 9).alias(c) for c in ("overlap_at_k", "kendall_tau")])


@query("stability_summary", f"""WITH {_PAIRS_SQL},
m AS (SELECT avg(overlap_at_k) AS o, avg(kendall_tau) AS t FROM over JOIN pairs
  ON over.fold_a = pairs.fold_a AND over.fold_b = pairs.fold_b)
SELECT round(coalesce(o, 1e0), 6) AS mean_overlap_at_k, round(coalesce(t, 1e0), 6) AS mean_kendall_tau,
  CASE WHEN o >= 0.8e0 THEN 'High' WHEN o >= 0.6e0 THEN 'Moderate' ELSE 'Low' END AS level FROM m""")
def stability_summary(spark, sf_dir):
    out = stability.summarize(_age_group_ranks(spark, sf_dir), folds=6, k=3)
    return out.select(
        F.round("mean_overlap_at_k", 6).alias("mean_overlap_at_k"),
        F.round("mean_kendall_tau", 6).alias("mean_kendall_tau"),
        F.substring_index("interpretation", " ", 1).alias("level"),
    )


_RULE = """CASE CAST(cp AS INTEGER) WHEN 1 THEN 'chol <= -0.52' WHEN 2 THEN '-0.10 < thalach <= 0.66'
  WHEN 3 THEN 'unmatched rule' ELSE '0.12 < ' || source_site || ' age <= 1.5' END"""


@query("rule_to_feature", f"""WITH {COHORT_CTE}, r AS (SELECT row_id, {_RULE} AS rule FROM clean)
SELECT row_id, CASE {" ".join(f"WHEN contains(rule, '{f}') THEN '{f}'" for f in fixed.FEATURE_COLUMNS)} ELSE rule END AS feature
FROM r""")
def rule_to_feature(spark, sf_dir):
    rules = clean(spark, sf_dir).select("row_id", F.expr(_RULE).alias("rule"))
    return rules.select("row_id", C.rule_feature("rule", fixed.FEATURE_COLUMNS).alias("feature"))


@query("shap_lime_compare", f"""WITH {_TWO},
x AS (SELECT a.row_id, string_agg(a.feature, ', ' ORDER BY a.k) AS shap_top_features FROM first a WHERE k <= 3 GROUP BY a.row_id),
y AS (SELECT b.row_id, string_agg(b.feature, ', ' ORDER BY b.k) AS lime_top_features FROM second b WHERE k <= 3 GROUP BY b.row_id),
c AS (SELECT a.row_id, CAST(count(CASE WHEN a.k <= 3 AND b.k <= 3 THEN 1 END) AS INTEGER) AS overlap_count
  FROM first a JOIN second b ON a.row_id = b.row_id AND a.feature = b.feature GROUP BY a.row_id)
SELECT c.row_id, 3 AS top_k, shap_top_features, lime_top_features, overlap_count, overlap_count / 3e0 AS overlap_ratio,
  CASE WHEN overlap_count / 3e0 >= 0.6e0 THEN 'Strong Agreement' ELSE 'Partial/Divergent Agreement' END AS agreement_status
FROM c JOIN x ON c.row_id = x.row_id JOIN y ON c.row_id = y.row_id""")
def shap_lime_compare(spark, sf_dir):
    lists = _two_lists(spark, sf_dir)
    return lists.withColumns(explain.compare(F.col("a"), F.col("b"), 3)).drop("a", "b")


# --- Shapley values ----------------------------------------------------------

_SHAP = ["age", "oldpeak", "chol", "thalach"]
_REFERENCE = {"age": 55.0, "oldpeak": 3.5, "chol": 240.0, "thalach": 140.0}
_CURVED = "({rf} * {ada} + {rf} / 2e0)"


def _curved(df, out):
    p = base_probabilities(feature_map())
    return df.withColumn(out, p["random_forest"] * p["adaboost"] + p["random_forest"] / 2.0)


def _shap_sql() -> str:
    d = len(_SHAP)
    joins = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    mixed = {f: f"m_{f}" for f in _SHAP}
    masked = ", ".join(
        f"CASE WHEN (mask // {2 ** i}) % 2 = 1 THEN {f} ELSE {_REFERENCE[f]}e0 END AS m_{f}" for i, f in enumerate(_SHAP)
    )
    p = _CURVED.format(rf=score_sql("random_forest", **mixed), ada=score_sql("adaboost", **mixed))
    size = " + ".join(f"(mask // {2 ** i}) % 2" for i in range(d))
    with_f = lambda i: f"CASE {' '.join(f'WHEN n = {s + 1} THEN {w!r}e0' for s, w in enumerate(joins))} END"
    without = f"CASE {' '.join(f'WHEN n = {s} THEN {w!r}e0' for s, w in enumerate(joins))} ELSE 0e0 END"
    sums = ", ".join(
        f"round(sum(CASE WHEN (mask // {2 ** i}) % 2 = 1 THEN {with_f(i)} ELSE -({without}) END * p), 6) + 0e0 AS {f}"
        for i, f in enumerate(_SHAP)
    )
    return f"""WITH {COHORT_CTE},
m AS (SELECT row_id, mask, {size} AS n, {masked} FROM (SELECT * FROM clean WHERE chol IS NOT NULL), range({2 ** d}) t(mask)),
v AS (SELECT row_id, mask, n, {p} AS p FROM m)
SELECT row_id, round(max(CASE WHEN mask = 0 THEN p END), 6) AS base,
  round(max(CASE WHEN mask = {2 ** d - 1} THEN p END), 6) AS p, {sums} FROM v GROUP BY row_id"""


@query("shapley_exact", _shap_sql())
def shapley_exact(spark, sf_dir):
    """Exact attributions of a curved scorer on every row that has all inputs."""
    df = clean(spark, sf_dir).where(F.col("chol").isNotNull()).select("row_id", *_SHAP, "trestbps")
    out = explain.shapley(df, _curved, _SHAP, _REFERENCE)
    return out.select("row_id", F.round("base", 6).alias("base"), F.round("p", 6).alias("p"),
                      *[(F.round(f, 6) + 0.0).alias(f) for f in _SHAP])


_LOCAL = ["age", "oldpeak", "chol", "thalach", "trestbps"]
_SAMPLES = 5000
_DIGITS = {"oldpeak": 1}  # quartiles are approximate; rounded ones can be written in SQL


def _surrogate_sums_sql() -> str:
    """The sums behind every local model, from the definition: every draw against every pattern of bins."""
    md5 = lambda what, f: f"CAST(CAST('0x' || substr(md5('42|{what}|' || CAST(s AS STRING) || '|{f}'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0"
    filled = ", ".join(f"coalesce({f}, (SELECT median({f}) FROM clean)) AS {f}" for f in _LOCAL)
    quarter = lambda f, k: f"round(quantile_disc({f}, {k / 4}), {_DIGITS.get(f, 0)}) AS {f}_{k}"
    edges = ", ".join(f"min({f}) AS {f}_0, {quarter(f, 1)}, {quarter(f, 2)}, {quarter(f, 3)}, max({f}) AS {f}_4" for f in _LOCAL)
    bin_sql = lambda f: f"CAST({f} > {f}_1 AS INTEGER) + CAST({f} > {f}_2 AS INTEGER) + CAST({f} > {f}_3 AS INTEGER)"
    ups = ", ".join(f"sum(CASE WHEN b_{f} <= {k} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS {f}_u{k}" for f in _LOCAL for k in range(3))
    picks = ", ".join(f"CAST({md5('bin', f)} >= {f}_u0 AS INTEGER) + CAST({md5('bin', f)} >= {f}_u1 AS INTEGER) + CAST({md5('bin', f)} >= {f}_u2 AS INTEGER) AS d_{f}, {md5('place', f)} AS v_{f}" for f in _LOCAL)
    right = lambda f: f"CASE d_{f} WHEN 0 THEN {f}_1 WHEN 1 THEN {f}_2 WHEN 2 THEN {f}_3 ELSE {f}_4 END"
    left = lambda f: f"CASE d_{f} WHEN 0 THEN {f}_0 WHEN 1 THEN {f}_1 WHEN 2 THEN {f}_2 ELSE {f}_3 END"
    values = ", ".join(f"{right(f)} - v_{f} * ({right(f)} - {left(f)}) AS {f}" for f in _LOCAL)
    p = _CURVED.format(rf=score_sql("random_forest"), ada=score_sql("adaboost"))
    same = {f: f"CAST(b_{f} = d_{f} AS DOUBLE)" for f in _LOCAL}
    z = " + ".join(same.values())
    sums = ", ".join(f"round(sum(w * {same[f]}), 6) AS wz_{f}, round(sum(w * {same[f]} * p), 6) AS wzp_{f}" for f in _LOCAL)
    keys = ", ".join(f"b_{f}" for f in _LOCAL)
    return f"""WITH {COHORT_CTE},
full0 AS (SELECT row_id, {filled} FROM clean), edges AS (SELECT {edges} FROM full0),
binned AS (SELECT row_id, {', '.join(f'{bin_sql(f)} AS b_{f}' for f in _LOCAL)} FROM full0, edges),
shares AS (SELECT {ups} FROM binned),
picked AS (SELECT s, {picks} FROM range(1, {_SAMPLES}) t(s), shares),
drawn AS (SELECT s, {', '.join(f'd_{f}' for f in _LOCAL)}, {values} FROM picked, edges),
scored AS (SELECT *, {p} AS p FROM drawn),
patterns AS (SELECT {keys}, count(*) AS n_rows FROM binned GROUP BY {keys}),
pairs AS (SELECT *, exp(({len(_LOCAL)} - ({z})) * (-0.5e0 / (0.5625e0 * {len(_LOCAL)}))) AS w FROM patterns, scored)
SELECT {keys}, n_rows, round(sum(w), 6) AS w, round(sum(w * p), 6) AS wp, {sums} FROM pairs GROUP BY {keys}, n_rows"""


def _local_rows(spark, sf_dir):
    df = clean(spark, sf_dir)
    df = prepare.fit(df, _LOCAL).transform(df, keep=["row_id"], scale=False)
    bins = explain.quartile_bins(df, _LOCAL)
    return df, {f: [e[0], *(round(q, _DIGITS.get(f, 0)) for q in e[1:4]), e[4]] for f, e in bins.items()}


@query("surrogate_sums", _surrogate_sums_sql())
def surrogate_sums(spark, sf_dir):
    """The weighted sums of the shared draws per pattern of quartile bins."""
    df, bins = _local_rows(spark, sf_dir)
    d = len(_LOCAL)
    drawn = _curved(explain.draws(spark, _LOCAL, bins, explain.bin_counts(df, _LOCAL, bins), _SAMPLES), "__p")
    patterns = df.groupBy(F.array(*[explain.bin_of(F.col(f), bins[f]) for f in _LOCAL]).alias("__bins")).agg(F.count("*").alias("n_rows"))
    sums = F.col("__sums")
    of = lambda k, name: F.round(sums[k], 6).alias(name)
    return explain.pattern_sums(patterns, drawn, d).select(
        *[F.col("__bins")[j].alias(f"b_{f}") for j, f in enumerate(_LOCAL)], "n_rows", of(0, "w"), of(1, "wp"),
        *[c for j, f in enumerate(_LOCAL) for c in (of(2 + j, f"wz_{f}"), of(2 + d + j, f"wzp_{f}"))])


@query("surrogate_fit")
def surrogate_fit(spark, sf_dir):
    """Local linear weights around every row; missing values are medians."""
    df, bins = _local_rows(spark, sf_dir)
    return explain.surrogate(df, _curved, _LOCAL, bins, top_k=3)


# --- counterfactuals ---------------------------------------------------------

_CF_FEATURES = list(fixed.ACTIONABLE)
_CF_BOUND = {
    "chol": "greatest(100e0, chol * 0.4e0)", "trestbps": "greatest(90e0, trestbps * 0.6e0)",
    "thalach": "least(210e0, thalach * 1.5e0)", "oldpeak": "0e0",
}


def _cf_score(df, out):
    p = base_probabilities(feature_map())
    return df.withColumn(out, (p["random_forest"] + p["xgboost"]) / 2.0)


def _cf_sql_score(**replaced) -> str:
    return f"(({score_sql('random_forest', **replaced)} + {score_sql('xgboost', **replaced)}) / 2e0)"


def _cf_grid(f: str, step: str, n: int) -> str:
    b = _CF_BOUND[f]
    return f"CASE WHEN {step} = {n - 1} THEN {b} ELSE {f} + CAST({step} AS DOUBLE) * (({b} - {f}) / {n - 1}e0) END"


def _cf_change(v: str, f: str) -> str:
    return f"abs({v} - {f}) / CASE WHEN {f} <> 0 THEN {f} ELSE 1e0 END"


def _cf_ctes() -> str:
    single = " UNION ALL ".join(
        f"""SELECT row_id, {i} AS which, step, v, {_cf_change('v', f)} AS pct, {_cf_sql_score(**{f: 'v'})} AS p, {f} AS o
        FROM (SELECT *, {_cf_grid(f, 'step', 50)} AS v FROM s0, range(50) t(step) WHERE p0 > 0.5e0 AND {f} IS NOT NULL)"""
        for i, f in enumerate(_CF_FEATURES)
    )
    dual = " UNION ALL ".join(
        f"""SELECT row_id, {n} AS pair, i, j, va, vb, {_cf_change('va', a)} + {_cf_change('vb', b)} AS pct,
        {_cf_sql_score(**{a: 'va', b: 'vb'})} AS p, {a} AS oa, {b} AS ob
        FROM (SELECT *, {_cf_grid(a, 'i', 15)} AS va, {_cf_grid(b, 'j', 15)} AS vb FROM rest, range(15) t(i), range(15) u(j)
              WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for n, (a, b) in enumerate(combinations(_CF_FEATURES, 2))
    )
    return f"""{COHORT_CTE},
s0 AS (SELECT *, {_cf_sql_score()} AS p0 FROM clean),
sp AS ({single}),
sf AS (SELECT * FROM sp WHERE p < 0.5e0 QUALIFY row_number() OVER (PARTITION BY row_id, which ORDER BY step) = 1),
sb AS (SELECT * FROM sf QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pct, which) = 1),
rest AS (SELECT * FROM s0 WHERE p0 > 0.5e0 AND row_id NOT IN (SELECT row_id FROM sb)),
dp AS ({dual}),
df AS (SELECT * FROM dp WHERE p < 0.5e0 QUALIFY row_number() OVER (PARTITION BY row_id, pair, i ORDER BY j) = 1),
db AS (SELECT * FROM df QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY pct, pair, i) = 1)"""


_CF_NAMES = "[" + ", ".join(f"'{f}'" for f in _CF_FEATURES) + "]"
_CF_A = "[" + ", ".join(f"'{a}'" for a, _ in combinations(_CF_FEATURES, 2)) + "]"
_CF_B = "[" + ", ".join(f"'{b}'" for _, b in combinations(_CF_FEATURES, 2)) + "]"


@query("cf_single", f"""WITH {_cf_ctes()}
SELECT s0.row_id, round(p0, 9) AS initial_prob, sb.row_id IS NOT NULL AS flipped, ({_CF_NAMES})[which + 1] AS f1,
  round(o, 9) AS orig_v1, round(v, 9) AS new_v1, round(p, 9) AS mod_prob, round(pct, 9) AS pct_change
FROM s0 LEFT JOIN sb ON s0.row_id = sb.row_id""")
def cf_single(spark, sf_dir):
    df = clean(spark, sf_dir)
    found = counterfactual.flat(counterfactual.find(df, _cf_score, dual_steps=0))
    rounded = [F.round(c, 9).alias(c) for c in ("initial_prob", "orig_v1", "new_v1", "mod_prob", "pct_change")]
    return found.select("row_id", "flipped", "f1", *rounded)


@query("cf_dual", f"""WITH {_cf_ctes()}
SELECT s0.row_id, round(p0, 9) AS initial_prob, sb.row_id IS NOT NULL OR db.row_id IS NOT NULL AS flipped,
  CASE WHEN sb.row_id IS NOT NULL THEN 'single' WHEN db.row_id IS NOT NULL THEN 'dual' END AS type,
  coalesce(({_CF_NAMES})[which + 1], ({_CF_A})[pair + 1]) AS f1, ({_CF_B})[pair + 1] AS f2,
  round(coalesce(v, va), 9) AS new_v1, round(vb, 9) AS new_v2, round(coalesce(sb.p, db.p), 9) AS mod_prob,
  round(coalesce(sb.pct, db.pct), 9) AS pct_change
FROM s0 LEFT JOIN sb ON s0.row_id = sb.row_id LEFT JOIN db ON s0.row_id = db.row_id""")
def cf_dual(spark, sf_dir):
    found = counterfactual.flat(counterfactual.find(clean(spark, sf_dir), _cf_score))
    rounded = [F.round(c, 9).alias(c) for c in ("initial_prob", "new_v1", "new_v2", "mod_prob", "pct_change")]
    return found.select("row_id", "flipped", "type", "f1", "f2", *rounded)


@query("cf_candidates", f"""WITH {COHORT_CTE}, s0 AS (SELECT row_id, {_cf_sql_score()} AS p0 FROM clean),
hit AS (SELECT * FROM s0 WHERE p0 BETWEEN 0.51e0 AND 0.85e0 ORDER BY row_id LIMIT 4),
spare AS (SELECT * FROM s0 ORDER BY row_id LIMIT 3)
SELECT row_id, round(p0, 9) AS p FROM hit
UNION ALL SELECT row_id, round(p0, 9) FROM spare WHERE NOT EXISTS (SELECT 1 FROM hit)""")
def cf_candidates(spark, sf_dir):
    df = _cf_score(clean(spark, sf_dir), "p").select("row_id", "p")
    return counterfactual.candidates(df, "p").withColumn("p", F.round("p", 9))


@query("cf_statements")
def cf_statements(spark, sf_dir):
    """What-if sentences of the candidate rows."""
    df = _cf_score(clean(spark, sf_dir), "p")
    picked = counterfactual.candidates(df, "p")
    return counterfactual.find(picked, _cf_score).select("row_id", "flipped", "statement", "disclaimer")


# --- scoring -----------------------------------------------------------------

_SCORE_SQL = f"""WITH {AGREE_CTE}, {_long_sql('first', _FIRST)},
t AS (SELECT row_id, string_agg(feature, ', ' ORDER BY k) AS top_features FROM first WHERE k <= 3 GROUP BY row_id),
f AS (SELECT patient_index, {FLAG_SQL} AS agreement_flag FROM agreed)
SELECT s.row_id, round(ensemble, 4) AS predicted_probability,
  CASE WHEN ensemble < 0.35e0 THEN 'Low Risk' WHEN ensemble < 0.65e0 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_label,
  agreement_flag, round(random_forest, 4) AS p_rf, round(xgboost, 4) AS p_xgb, round(adaboost, 4) AS p_ada, top_features
FROM scored s JOIN t ON s.row_id = t.row_id JOIN f ON s.row_id = f.patient_index"""


def _score_plan(raw):
    """Raw inputs to flat result columns; stateless, so it also runs on a stream."""
    df = cleaning.clean_cohort(raw).withColumns(base_probabilities(feature_map()))
    df = df.withColumn(fixed.ENSEMBLE, agreement.soft_vote(*fixed.BASE_MODELS))
    out = scoring.results(df, ["row_id"], explain.contributions(_values(_FIRST), 3))
    probability = lambda m: F.element_at("base_model_probabilities", F.lit(fixed.DISPLAY_NAMES[m]))
    return out.select(
        "row_id", "predicted_probability", "risk_label", "agreement_flag",
        probability("random_forest").alias("p_rf"), probability("xgboost").alias("p_xgb"),
        probability("adaboost").alias("p_ada"),
        F.array_join(F.transform("top_contributing_features", lambda s: s["feature"]), ", ").alias("top_features"),
    )


@query("score_batch", _SCORE_SQL)
def score_batch(spark, sf_dir):
    return _score_plan(raw_cohort(spark, sf_dir))


@query("score_stream", _SCORE_SQL)
def score_stream(spark, sf_dir):
    """The same plan on a file stream; the result equals the batch result."""
    schema = table(spark, sf_dir, "lineitem").schema
    return run_score_stream(
        spark, sf_dir, schema, lambda s: _score_plan(s.selectExpr(*_items(LINEITEM_AS_COHORT))), glob="lineitem.parquet"
    )


@query("score_report")
def score_report(spark, sf_dir):
    df = scored(spark, sf_dir)
    out = scoring.results(df, ["row_id"], explain.contributions(_values(_FIRST), 3))
    return out.select("row_id", scoring.report_text().alias("report"))


# --- learners ----------------------------------------------------------------

# small ensembles: the searches below run over whole tables, so the models are
# kept short; the default spaces are those of the library
_U = "CAST(CAST('0x' || substr(md5('42|{kind}|' || CAST({id} AS STRING) || '|{name}'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0"


def _trial_sql(kind: str, source: str, trial: str) -> str:
    items = []
    for name, (how, *b) in fixed.SEARCH_SPACES[kind].items():
        u = _U.format(kind=kind, name=name, id=trial)
        if how == "int":
            items.append(f"CAST({b[0]} + floor(({u}) * {b[1] - b[0] + 1}) AS INTEGER) AS {name}")
        elif how == "float":
            items.append(f"round({b[0]}e0 + ({u}) * {b[1] - b[0]}e0, 9) AS {name}")
        elif how == "log":
            items.append(f"round(exp(ln({b[0]}e0) + ({u}) * (ln({b[1]}e0) - ln({b[0]}e0))), 9) AS {name}")
        else:
            arms = " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(b))
            items.append(f"CASE CAST(floor(({u}) * {len(b)}) AS INTEGER) {arms} END AS {name}")
    return f"SELECT {trial} AS trial, {', '.join(items)} FROM {source}"


def _trials(spark, sf_dir, kind: str, source: str, trial: str):
    """One trial of a search space per key of a table."""
    df = search.add_trials(table(spark, sf_dir, source).select(F.col(trial).alias("trial")), kind)
    return df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"})


@query("search_trials", _trial_sql("xgboost", "customer", "c_custkey"))
def search_trials(spark, sf_dir):
    return _trials(spark, sf_dir, "xgboost", "customer", "c_custkey")


@query("search_trials_forest", _trial_sql("random_forest", "part", "p_partkey"))
def search_trials_forest(spark, sf_dir):
    return _trials(spark, sf_dir, "random_forest", "part", "p_partkey")


@query("search_trials_adaboost", _trial_sql("adaboost", "supplier", "s_suppkey"))
def search_trials_adaboost(spark, sf_dir):
    return _trials(spark, sf_dir, "adaboost", "supplier", "s_suppkey")


@query("random_search")
def random_search(spark, sf_dir):
    """Trial table of a boosting search over the cohort."""
    df = clean(spark, sf_dir)
    fitted = prepare.fit(df, fixed.FEATURE_COLUMNS)
    names = fitted.feature_names()
    ready = learners.assemble(fitted.transform(df, keep=["row_id", "target"]), names)
    _, _, trials = search.search(ready, "xgboost", names, "row_id")
    return trials


@query("adaboost")
def adaboost(spark, sf_dir):
    """Boosted stumps fitted on and applied to the cohort."""
    df = clean(spark, sf_dir)
    fitted = prepare.fit(df, fixed.FEATURE_COLUMNS)
    ready = fitted.transform(df, keep=["row_id", "target"])
    model = learners.AdaBoost().fit(ready, fitted.feature_names())
    return model.score(ready, "p").select("row_id", "target", "p")


@query("tree_attribution")
def tree_attribution(spark, sf_dir):
    """Path attributions of a fitted boosted model for every row."""
    df = clean(spark, sf_dir)
    fitted = prepare.fit(df, fixed.FEATURE_COLUMNS)
    ready = fitted.transform(df, keep=["row_id", "target"])
    model = learners.GradientBoosting().fit(ready, fitted.feature_names())
    return explain.tree_attribution(ready, model, ["row_id"])


@query("nested_cv")
def nested_cv(spark, sf_dir):
    """Per model: fold means and deviations of out-of-fold predictions."""
    return nested.summary(nested.out_of_fold(clean(spark, sf_dir), parallelism=8))


@query("external_compare")
def external_compare(spark, sf_dir):
    """Per model: single-site CV, combined CV and the external cohort, in the common schema."""
    raw = raw_cohort(spark, sf_dir)
    single = harmonize.from_cohort(raw.where(F.col(fixed.SITE) == fixed.TRUSTED_SITE), keep=["row_id"])
    combined = harmonize.from_cohort(raw, keep=["row_id"])
    outside = harmonize.from_external(raw_external(spark, sf_dir), keep=["row_id"])
    return external_plan.run(single, combined, outside)


@query("fitted_stability")
def fitted_stability(spark, sf_dir):
    """Ranking stability of boosted models fitted on stratified folds."""
    return stability_plan.evaluate(clean(spark, sf_dir))


@query("train_score")
def train_score(spark, sf_dir):
    """Train, persist, load again, then score every raw input."""
    folder = work_folder(spark, "models")
    df = clean(spark, sf_dir)
    fitted = train.load_or_train(df, folder)
    return scoring.score(raw_cohort(spark, sf_dir), fitted).withColumn("report", scoring.report_text())


# --- boosting ------------------------------------------------------------------

_BOOST_CUTS = {
    "age": [float(v) for v in range(25, 90, 5)], "trestbps": [float(v) for v in range(90, 215, 5)], "chol": [float(v) for v in range(100, 575, 25)],
    "thalach": [float(v) for v in range(65, 220, 5)], "oldpeak": [v / 2 for v in range(1, 14)],
}
_BOOST = boosting.Spec(rounds=1, max_depth=1, rate=0.3, l2=1.5, gamma=0.25, min_child_weight=2.0)


def _boost_sql() -> str:
    """The first split of every fold's model, from gradients p - y and hessians p (1 - p) at p = 1/2."""
    bins = ", ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE len(list_filter({cuts!r}, lambda c: c < {f})) END AS b{j}" for j, (f, cuts) in enumerate(_BOOST_CUTS.items()))
    long = " UNION ALL ".join(f"SELECT fold, {j} AS feature, b{j} AS bin, y FROM binned" for j in range(len(_BOOST_CUTS)))
    b = _BOOST
    worth = lambda g, h: f"({g}) * ({g}) / ({h} + {b.l2}e0)"
    value = lambda g, h: f"round(-{b.rate}e0 * ({g}) / ({h} + {b.l2}e0), 9)"
    cut = "CAST(CASE feature " + " ".join(f"WHEN {j} THEN ({cuts!r})[bin + 1]" for j, cuts in enumerate(_BOOST_CUTS.values())) + " END AS DOUBLE)"
    return f"""WITH {FOLD_CTE},
binned AS (SELECT fold, y_true AS y, {bins} FROM folded),
long AS ({long}),
cells AS (SELECT m.model, feature, bin, sum(0.5e0 - y) AS g, sum(0.25e0) AS h FROM long, range({FOLDS}) m(model) WHERE fold <> m.model GROUP BY m.model, feature, bin),
run AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY model, feature) AS gt, sum(h) OVER (PARTITION BY model, feature) AS ht,
  max(bin) OVER (PARTITION BY model, feature) AS last FROM cells WINDOW w AS (PARTITION BY model, feature ORDER BY bin)),
gains AS (SELECT *, gt - gl AS gr, ht - hl AS hr, 0.5e0 * ({worth('gl', 'hl')} + {worth('gt - gl', '(ht - hl)')} - {worth('gt', 'ht')}) - {b.gamma}e0 AS gain FROM run WHERE bin < last)
SELECT CAST(model AS INTEGER) AS model, ({list(_BOOST_CUTS)!r})[feature + 1] AS feature, {cut} AS cut, round(gain, 6) AS gain,
  {value('gl', 'hl')} AS value_left, {value('gr', 'hr')} AS value_right
FROM gains WHERE hl >= {b.min_child_weight}e0 AND hr >= {b.min_child_weight}e0 AND gain > 0
QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, feature, bin) = 1"""


@query("boost_level", _boost_sql())
def boost_level(spark, sf_dir):
    """One level of all folds' boosted models: cells of gradients and hessians, then the best split of each."""
    names = list(_BOOST_CUTS)
    df = folds.stratified(clean(spark, sf_dir).select("row_id", F.col("target").alias("y_true"), *names), "row_id", "y_true", FOLDS, SEED, "fold")
    rows = boosting.binned(df.withColumns({"__y": F.col("y_true").cast("double"), "__fold": F.col("fold").cast("int"), "__u": F.xxhash64("row_id")}),
                           names, list(_BOOST_CUTS.values()), ["__y", "__fold", "__u"])
    specs = [boosting.Spec(**{**vars(_BOOST), "left_out": k}) for k in range(FOLDS)]
    width, used = max(len(c) for c in _BOOST_CUTS.values()) + 1, list(range(len(names)))
    turns = {m: boosting.Turn(boosting.Tree(), np.array([0]), used, 0) for m in range(FOLDS)}
    best = boosting.best_splits(boosting.level_cells(rows, specs, turns, {}, width), specs, turns, width)
    value = lambda g, h: F.round(F.col(g) * -_BOOST.rate / (F.col(h) + _BOOST.l2), 9)
    cuts = F.array(*[F.array(*[F.lit(c) for c in some]) for some in _BOOST_CUTS.values()])
    return best.where("gain IS NOT NULL").select(
        "model", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1).alias("feature"), cuts[F.col("feature")][F.col("bin")].alias("cut"),
        F.round("gain", 6).alias("gain"), value("gl", "hl").alias("value_left"), value("gr", "hr").alias("value_right"))


# --- AdaBoost ------------------------------------------------------------------

_VOTED = stumps.Stump(list(_BOOST_CUTS).index("oldpeak"), 1.0, -1, 1, 0.9)      # the vote that the round starts from
_RATE = 0.7


def _round_sql() -> str:
    """The second stump of every fold's model: weights exp(-y m / 2) after one vote, least Gini impurity, then its error and weight."""
    bins = ", ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE len(list_filter({cuts!r}, lambda c: c < {f})) END AS b{j}" for j, (f, cuts) in enumerate(_BOOST_CUTS.items()))
    vote = f"CASE WHEN oldpeak > {_VOTED.threshold} THEN {_VOTED.weight}e0 ELSE -{_VOTED.weight}e0 END"
    long = " UNION ALL ".join(f"SELECT fold, {j} AS feature, b{j} AS bin, y, w FROM binned" for j in range(len(_BOOST_CUTS)))
    mixed = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN {a} * {b} / ({a} + {b}) ELSE 0e0 END"
    cut = "CAST(CASE feature " + " ".join(f"WHEN {j} THEN ({cuts!r})[bin + 1]" for j, cuts in enumerate(_BOOST_CUTS.values())) + " END AS DOUBLE)"
    return f"""WITH {FOLD_CTE},
binned AS (SELECT fold, y_true AS y, exp(-0.5e0 * (2 * y_true - 1) * ({vote})) AS w, {bins} FROM folded),
long AS ({long}),
cells AS (SELECT m.model, feature, bin, sum(CASE WHEN y = 0 THEN w ELSE 0e0 END) AS w0, sum(CASE WHEN y = 1 THEN w ELSE 0e0 END) AS w1
  FROM long, range({FOLDS}) m(model) WHERE fold <> m.model GROUP BY m.model, feature, bin),
run AS (SELECT model, feature, bin, sum(w0) OVER w AS l0, sum(w1) OVER w AS l1, sum(w0) OVER a AS t0, sum(w1) OVER a AS t1, max(bin) OVER a AS last
  FROM cells WINDOW w AS (PARTITION BY model, feature ORDER BY bin), a AS (PARTITION BY model, feature)),
sides AS (SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM run WHERE bin < last),
best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY model ORDER BY {mixed('l0', 'l1')} + {mixed('r0', 'r1')}, feature, bin) = 1),
wrong AS (SELECT *, (least(l0, l1) + least(r0, r1)) / (t0 + t1) AS e FROM best)
SELECT CAST(model AS INTEGER) AS model, ({list(_BOOST_CUTS)!r})[feature + 1] AS feature, {cut} AS cut, CAST(CASE WHEN l1 > l0 THEN 1 ELSE -1 END AS INTEGER) AS vote_left,
  CAST(CASE WHEN r1 > r0 THEN 1 ELSE -1 END AS INTEGER) AS vote_right, round(e, 6) AS error, round({_RATE}e0 * ln((1 - e) / e), 6) AS weight FROM wrong"""


@query("adaboost_round", _round_sql())
def adaboost_round(spark, sf_dir):
    """One round of all folds' AdaBoost models: class weights per bin after one vote, then the best stump, its error and weight."""
    names, cuts = list(_BOOST_CUTS), list(_BOOST_CUTS.values())
    df = folds.stratified(clean(spark, sf_dir).select("row_id", F.col("target").alias("y_true"), *names), "row_id", "y_true", FOLDS, SEED, "fold")
    rows = stumps.prepared(df, names, cuts, "y_true", "fold")
    specs = [stumps.Spec(k, 2, _RATE) for k in range(FOLDS)]
    best = stumps.best_stumps(stumps.round_cells(rows, specs, [stumps.steps([_VOTED], cuts)] * FOLDS, cuts))
    vote = lambda a, b: F.when(F.col(b) > F.col(a), 1).otherwise(-1)
    error = (F.least("l0", "l1") + F.least("r0", "r1")) / (F.col("t0") + F.col("t1"))
    edges = F.array(*[F.array(*[F.lit(c) for c in some]) for some in cuts])
    return best.where("feature IS NOT NULL").select(
        "model", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("feature") + 1).alias("feature"), edges[F.col("feature")][F.col("bin")].alias("cut"),
        vote("l0", "l1").alias("vote_left"), vote("r0", "r1").alias("vote_right"), F.round(error, 6).alias("error"),
        F.round(F.log((1 - error) / error) * _RATE, 6).alias("weight"))
