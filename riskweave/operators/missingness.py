"""Missing-value reporting and simple counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave.functions import fixed

OVERALL = "combined_overall"


def report(df: DataFrame, features: list[str] = None, site: str = fixed.SITE, digits: int = 2) -> DataFrame:
    """Percent missing per feature, one row per site and one over everything.

    The cohort is read once: counts are reduced per site, and the overall row is
    rolled up from those few rows.  Rows without a site count only overall.
    """
    features = features or [c for c in fixed.FEATURE_COLUMNS if c in df.columns]
    per_site = df.groupBy(site).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in features],
    )
    rolled = per_site.rollup(site).agg(
        F.grouping(site).alias("__all"),
        *[F.round(F.sum(c) * F.lit(100.0) / F.sum("__n"), digits).alias(c) for c in features],
    )
    named = rolled.where((F.col("__all") == 1) | F.col(site).isNotNull())
    return named.select(
        F.when(F.col("__all") == 1, OVERALL).otherwise(F.col(site)).alias(site), *features
    )


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
