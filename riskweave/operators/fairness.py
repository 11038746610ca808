"""Subgroup performance over several group columns at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import metrics, ranks
from riskweave.session import enough_tasks

#: Scored rows of a range of scores; each is there once per dimension.
ROWS_PER_TASK = 50_000

ALL_COLUMNS = [
    "sample_size", "disease_prevalence", "accuracy", "recall", "precision", "specificity", "f1_score", "roc_auc",
]


def with_groups(df: DataFrame, age: str = "age", sex: str = "sex") -> DataFrame:
    label = C.sex_label(sex) if sex in df.columns else F.lit(fixed.SEX_UNKNOWN)
    return df.withColumns({"sex_label": label, "age_band": C.age_band(age)})


def _shape(measured: DataFrame, keys: list[str]) -> DataFrame:
    return measured.select(
        *keys,
        F.col("n").alias("sample_size"),
        C.ratio((F.col("fn") + F.col("tp")) * 100.0, F.col("n")).alias("disease_prevalence"),
        "accuracy", "recall", "precision", "specificity", F.col("f1").alias("f1_score"), "roc_auc",
    )


def subgroups(df: DataFrame, group: str, keys: list[str] = (), label: str = "y_true",
              pred: str = "y_pred", score: str = "y_prob") -> DataFrame:
    """Metrics per value of one group column; AUC is NULL for a one-class group."""
    rows = df.where(F.col(group).isNotNull()).withColumn("subgroup", F.col(group).cast("string"))
    keys = [*keys, "subgroup"]
    return _shape(metrics.extended(rows, keys, label, pred, score), keys)


def breakdown(df: DataFrame, dimensions: list[str] = None, keys: list[str] = (), label: str = "y_true",
              pred: str = "y_pred", score: str = "y_prob", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Metrics over sex, age band and (if present) site in one plan.

    The scored rows are first reduced to confusion counts per (dimensions, score).
    Those counts are dealt out by ranges of the score, a bounded number of rows to
    each task, and spread over the dimensions there: sums and running totals of a
    range need no other task, and only one row per subgroup and range leaves it.
    """
    if dimensions is None:
        dimensions = ["sex_label", "age_band"] + ([fixed.SITE] if fixed.SITE in df.columns else [])
    keys, cells = list(keys), ["tn", "fp", "fn", "tp"]
    # rows without a label, prediction or score are left out by their count: as a filter, the
    # test would be moved to the scan, with the score's whole expression once more for each mention
    counts = metrics.confusion(df, [*keys, *dimensions, score], label, pred, present=[label, pred, score])
    counts = counts.where(F.col("n_present") > 0).drop("n_present")
    # cut points from the rows themselves: the expansion has the same scores
    tasks = enough_tasks(df, rows_per_task)
    ranges = ranks.bucketed(counts, score, ranks.cut_points(df, score, tasks)).repartitionById(tasks, ranks.BUCKET)
    parts = ", ".join(f"'{d}', cast(`{d}` as string)" for d in dimensions)
    spread = ranges.select(
        *keys, score, ranks.BUCKET, *cells,
        F.expr(f"stack({len(dimensions)}, {parts}) as (dimension, subgroup)"),
    ).where(F.col("subgroup").isNotNull())
    out_keys = [*keys, "dimension", "subgroup"]
    spread = spread.groupBy(*out_keys, ranks.BUCKET, score).agg(*[F.sum(c).alias(c) for c in cells])
    measured = metrics.by_ranges(spread, out_keys, score)
    return _shape(measured, out_keys).withColumn("caveat", F.lit(fixed.SUBGROUP_CAVEAT))
