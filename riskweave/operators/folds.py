"""Deterministic stratified splits.

Positions come from the md5 digest of the row id, so a split depends on nothing
but ids and seed: not on partitioning, retries or cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from riskweave.operators import ranks


def stratified(df: DataFrame, row_id: str, label: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Add a fold in 0..k-1; class counts of any two folds differ by at most one.

    All columns of ``df`` travel with the ids through one shuffle, so select what
    the next step needs before.
    """
    ranked = ranks.hash_order(df, [label], row_id, seed, "__rank")
    return ranked.withColumn(out, F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__rank")


def quotas(class_counts: dict, fraction: float) -> dict:
    """Rows to hold out per class: ``ceil(fraction * n)`` shared by largest
    remainder, the smaller class first on ties."""
    total = sum(class_counts.values())
    wanted = math.ceil(fraction * total)
    exact = {c: wanted * n / total for c, n in class_counts.items()} if total else {}
    out = {c: math.floor(x) for c, x in exact.items()}
    by_rest = sorted(exact, key=lambda c: (-(exact[c] - out[c]), c))
    for c in by_rest[: wanted - sum(out.values())]:
        out[c] += 1
    return out


def holdout(df: DataFrame, row_id: str, label: str, fraction: float = 0.25, seed: int = 42,
            out: str = "is_holdout") -> DataFrame:
    """Add a 0/1 flag marking a stratified share of the rows.

    Only the class sizes (one number per class) reach the driver.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    wanted = quotas(sizes, fraction)
    quota = None
    for c, n in wanted.items():
        hit = F.col(label).eqNullSafe(F.lit(c))
        quota = F.when(hit, n) if quota is None else quota.when(hit, n)
    ranked = ranks.hash_order(df, [label], row_id, seed, "__rank")
    return ranked.withColumn(out, (F.col("__rank") < quota).cast("int")).drop("__rank")
