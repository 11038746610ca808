"""Per-row agreement of the base models, and how accuracy follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from riskweave.functions import columns as C, fixed


def wide(long: DataFrame, row_id: str = "row_id", models: list[str] = fixed.ALL_MODELS,
         score: str = "y_prob", extra: list[str] = ()) -> DataFrame:
    """One row per scored row with a probability column per model.

    Conditional maxima instead of a pivot: one partial aggregate, no pass to
    discover the model names.
    """
    return long.groupBy(row_id, *extra).agg(
        *[F.max(F.when(F.col("model") == m, F.col(score))).alias(m) for m in models]
    )


def analyze(df: DataFrame, row_id: str = "row_id", rf: str = "random_forest", xgb: str = "xgboost",
            ada: str = "adaboost", label: str = "y_true", pred: str = "y_pred",
            high: float = fixed.AGREE_HIGH_BELOW, low: float = fixed.AGREE_MODERATE_BELOW) -> DataFrame:
    """The ten-column agreement table: a single projection, no shuffle."""
    std = C.spread(rf, xgb, ada)
    level = C.agreement_level(std, high, low)
    return df.select(
        F.col(row_id).alias("patient_index"),
        F.col(label).alias("y_true"), F.col(pred).alias("y_pred"),
        F.col(rf).alias("rf_prob"), F.col(xgb).alias("xgb_prob"), F.col(ada).alias("ada_prob"),
        std.alias("std_dev"), level.alias("agreement_level"),
        (F.col(label) == F.col(pred)).cast("int").alias("is_correct"),
        C.agreement_flag(rf, xgb, ada, level).alias("flag_string"),
    )


def summarize(analyzed: DataFrame) -> DataFrame:
    """Size, share and accuracy per level; an empty level stays, with NULL accuracy.

    The three level names are literals: their counts are conditional sums of one
    global aggregate, so an empty level needs no join to appear.
    """
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, level in enumerate(fixed.AGREE_LEVELS):
        at = F.col("agreement_level") == level
        aggs += [F.count_if(at).alias(f"n{i}"), F.sum(F.when(at, F.col("is_correct"))).alias(f"c{i}")]
    sums = analyzed.agg(*aggs)
    parts = ", ".join(f"{i}, '{level}', n{i}, c{i}" for i, level in enumerate(fixed.AGREE_LEVELS))
    rows = sums.select(
        "total",
        F.expr(f"stack({len(fixed.AGREE_LEVELS)}, {parts}) as (level_order, agreement_level, sample_size, correct)"),
    )
    return rows.select(
        "level_order", "agreement_level", "sample_size",
        C.ratio(F.col("sample_size") * 100.0, F.col("total"), 0.0).alias("pct_of_total"),
        C.ratio("correct", "sample_size").alias("accuracy"),
    )


def examples(analyzed: DataFrame, per_level: int = 2) -> DataFrame:
    """The first rows of each level in row order.

    Spark keeps only ``per_level`` rows per task before the shuffle
    (``WindowGroupLimit``), so a level with most of the rows is no bottleneck.
    """
    order = W.partitionBy("agreement_level").orderBy("patient_index")
    return analyzed.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= per_level).drop("__k")


def soft_vote(*probabilities):
    """Unweighted mean probability."""
    cols = [C.as_column(p) for p in probabilities]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def label_of(p):
    """Class 1 only strictly above one half."""
    return (C.as_column(p) > fixed.DECISION_THRESHOLD).cast("int")


def hard_vote(*labels):
    """Majority label; a tie goes to the smaller class."""
    cols = [C.as_column(c) for c in labels]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return (total * 2 > len(cols)).cast("int")
