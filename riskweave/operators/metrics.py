"""Classification metrics.  Every function takes ``keys``: per model, per fold,
per subgroup and overall are the same code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from riskweave.functions import columns as C
from riskweave.operators import ranks


def confusion(df: DataFrame, keys: list[str] = (), label: str = "y_true", pred: str = "y_pred",
              weight: str | None = None, present: list[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one pass; always all four, also when a class is absent.

    ``weight`` is a row count for tables that were already reduced.  ``present`` adds
    ``n_present``, the rows in which none of these columns is missing.
    """
    times = F.lit(1) if weight is None else F.col(weight)

    def cell(y: int, p: int):
        hit = (F.col(label) == y) & (F.col(pred) == p)
        return F.sum(F.when(hit, times).otherwise(0)).cast("long")

    counted = []
    if present:
        floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        there = [F.col(c).isNotNull() & ~F.isnan(c) if c in floating else F.col(c).isNotNull() for c in present]
        counted = [F.count_if(reduce(lambda a, b: a & b, there)).alias("n_present")]
    return df.groupBy(*keys).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), *counted
    )


def rates(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts.

    precision, recall and F1 are 0 where undefined; specificity is NULL without
    negatives; ``is_degenerate`` tells that one label was predicted throughout.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "n": tn + fp + fn + tp,
        "accuracy": C.ratio(tp + tn, tn + fp + fn + tp),
        "precision": C.ratio(tp, tp + fp, 0.0),
        "recall": C.ratio(tp, tp + fn, 0.0),
        "f1": C.ratio(2 * tp, 2 * tp + fp + fn, 0.0),
        "specificity": C.ratio(tn, tn + fp),
        "is_degenerate": ((tp + fp) == 0) != ((tn + fn) == 0),
    })


def classification(df: DataFrame, keys: list[str] = (), label: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return rates(confusion(df, keys, label, pred))


def _rank_sums() -> tuple:
    """Aggregates over per-score counts for ROC-AUC and PR-AUC.

    Going down the scores, the point before a score is the point after it minus
    the score's own counts, so no second window is needed.  Products are taken in
    double: a count product would overflow a long from about 3e9 rows on.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    neg_below = F.col("below_neg").cast("double")
    tp = F.col("total_pos").cast("double") - F.col("below_pos").cast("double")
    fp = F.col("total_neg").cast("double") - neg_below
    here = C.ratio(tp, tp + fp, 1.0)
    before = C.ratio(tp - pos, tp - pos + fp - neg, 1.0)
    return (
        F.sum(pos * (neg_below + neg / 2.0)).alias("__u"),
        F.sum(pos * (here + before) / 2.0).alias("__a"),
    )


def _rank_values(n_pos, n_neg) -> dict:
    n_pos, n_neg = n_pos.cast("double"), n_neg.cast("double")
    both = (n_pos > 0) & (n_neg > 0)
    return {
        "roc_auc": F.when(both, F.col("__u") / (n_pos * n_neg)),
        "pr_auc": F.when(both, F.col("__a") / n_pos),
    }


def rank_metrics(df: DataFrame, keys: list[str] = (), label: str = "y_true", score: str = "y_prob",
                 cuts: list[float] | None = None) -> DataFrame:
    """Exact ROC-AUC (ties averaged) and PR-AUC (trapezoid, anchored at recall 0,
    precision 1); both NULL for a one-class group."""
    keys = list(keys)
    ranked = ranks.label_ranks(df, keys, label, score, cuts)
    summed = ranked.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), *_rank_sums()
    )
    return summed.withColumns(_rank_values(F.col("n_pos"), F.col("n_neg"))).select(
        *keys, "n_pos", "n_neg", "roc_auc", "pr_auc"
    )


def extended(df: DataFrame, keys: list[str] = (), label: str = "y_true", pred: str = "y_pred",
             score: str | None = "y_prob", cuts: list[float] | None = None,
             weight: str | None = None) -> DataFrame:
    """All metrics of a scored table in one plan.

    Label, prediction and score are reduced to counts per distinct score once;
    the confusion counts and the rank metrics both come from that.  Rows
    without a label or a prediction are left out, and those without a score where
    scores are measured.
    """
    keys = list(keys)
    df = df.dropna(subset=[label, pred, *([score] if score else [])])
    if score is None:
        return rates(confusion(df, keys, label, pred, weight)).withColumns(
            {"roc_auc": F.lit(None).cast("double"), "pr_auc": F.lit(None).cast("double")}
        )
    if cuts is None:
        cuts = ranks.cut_points(df, score)
    counts = confusion(df, [*keys, score], label, pred, weight).withColumns(
        {"neg": F.col("tn") + F.col("fp"), "pos": F.col("fn") + F.col("tp")}
    )
    # "neg" first: both branches then ask for the four counts in the same order
    # and share one shuffle
    ranked = ranks.running_totals(counts, keys, score, ["neg", "pos"], cuts)
    summed = ranked.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")], *_rank_sums()
    )
    return rates(summed).withColumns(
        _rank_values(F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp"))
    ).drop("__u", "__a")


def by_ranges(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rates and ROC-AUC from confusion counts per (keys, range of scores, score), ranges in ``ranks.BUCKET``.

    A range is summed up where it lies: what its positives gain from the negatives
    of the ranges below is their number times a sum, so only one row per key and
    range is shuffled, and nothing is joined back.
    """
    keys, cells = list(keys), ["tn", "fp", "fn", "tp"]
    inside = W.partitionBy(*keys, ranks.BUCKET).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy(*keys).orderBy(ranks.BUCKET).rowsBetween(W.unboundedPreceding, -1)
    pos, neg = F.col("fn") + F.col("tp"), F.col("tn") + F.col("fp")
    local = counts.withColumn("__below", F.coalesce(F.sum(neg).over(inside), F.lit(0)))
    ranges = local.groupBy(*keys, ranks.BUCKET).agg(
        *[F.sum(c).alias(c) for c in cells],
        F.sum(pos.cast("double") * (F.col("__below").cast("double") + neg.cast("double") / 2.0)).alias("__u"),
    ).withColumn("__below", F.coalesce(F.sum(neg).over(below), F.lit(0)))
    summed = ranges.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in cells],
        F.sum(F.col("__u") + pos.cast("double") * F.col("__below").cast("double")).alias("__u"),
    )
    return rates(summed).withColumn("roc_auc", _rank_values(pos, neg)["roc_auc"]).drop("__u")


def fold_summary(per_fold: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric over folds."""
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std")]
    return per_fold.groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, value: str, bins: int = 20, keys: list[str] = ()) -> DataFrame:
    """Equal-width histogram between the observed extremes (data only).

    The two extremes come from one aggregate and enter the plan as literals;
    counts are reduced before the shuffle.  Every bin is there, empty ones with 0
    rows, for every key that occurs; without any value there are no bins.
    """
    keys = list(keys)
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if span is None or span["lo"] is None:
        lo, width = 0.0, 1.0
    else:
        lo, width = float(span["lo"]), (float(span["hi"]) - float(span["lo"])) / bins
    if width == 0.0:
        lo, width = lo - 0.5, 1.0 / bins
    index = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # a key's bins meet in one row, so the empty ones need no join
    filled = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    return (
        filled.where(F.size("_n") > 0)
        .select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(*keys, "bin", F.coalesce(F.col("_n")[F.col("bin")], F.lit(0)).alias("n"))
        .withColumns({
            "bin_lo": F.lit(lo) + F.col("bin") * F.lit(width),
            "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width),
        })
    )
