"""Exact running totals and order statistics without a one-task sort.

A window without a fine partition key runs in one task.  Here the value axis is
cut at approximate quantiles first, so the running total is built in two levels:
inside ``(keys, bucket)`` windows, plus the totals of the buckets before.  The
cut points only balance the work; any cut points give the same exact result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

BUCKET = "__bucket"


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Distinct approximate quantiles of ``value``; at most ``buckets - 1`` doubles.

    Values that repeat a lot collapse to one cut point here and to one row in
    the counts, so neither a hot value nor a narrow dense range fills a bucket.
    """
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets < 2:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(value).cast("double").alias(value)).approxQuantile(value, probs, 0.25 / buckets)
    return sorted(set(found))


def bucketed(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=BUCKET, handleInvalid="keep").transform(df)
    # never NULL: a join on it must not send a filter on the score's whole expression
    # down one of its two inputs, which would also keep them from sharing a shuffle
    return cut.withColumn(BUCKET, F.coalesce(F.col(BUCKET).cast("int"), F.lit(-1)))


def running_totals(counts: DataFrame, keys: list[str], value: str, measures: list[str],
                   cuts: list[float]) -> DataFrame:
    """Add ``below_<m>`` and ``total_<m>`` to one-row-per-value counts.

    ``below`` is the sum over strictly smaller values of the same key, ``total``
    the sum over the key.  ``counts`` must have one row per (keys, value).
    """
    # never-NULL stand-ins for the keys: a group with a NULL in it then joins by
    # plain equality, on the partitioning the window below already has
    stand_ins = _never_null(counts, keys)
    rows = bucketed(counts, value, cuts).withColumns(stand_ins)
    names = list(stand_ins)
    sizes = rows.groupBy(*names, BUCKET).agg(*[F.sum(m).alias(f"__s_{m}") for m in measures])
    # at most len(cuts) + 1 rows per key reach these two windows
    before = W.partitionBy(*names).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*names)
    offsets = sizes.select(
        *names, BUCKET,
        *[F.coalesce(F.sum(f"__s_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__s_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    inside = W.partitionBy(*names, BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{m}": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    return local.join(offsets, [*names, BUCKET]).select(
        *counts.columns,
        *[(F.col(f"__l_{m}") + F.col(f"__o_{m}")).alias(f"below_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )


def _never_null(df: DataFrame, keys: list[str]) -> dict:
    """Key columns as pairs (is missing, value or a default)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for i, c in enumerate(keys):
        if isinstance(types[c], T.NumericType):
            value = F.coalesce(F.col(c), F.lit(0).cast(types[c]))
        else:
            value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        out[f"__v{i}"], out[f"__n{i}"] = value, F.col(c).isNull()
    return out


def score_counts(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; reduced before any shuffle."""
    return df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"),
    )


def label_ranks(df: DataFrame, keys: list[str], label: str, score: str,
                cuts: list[float] | None = None) -> DataFrame:
    """Per distinct score: its class counts and the class counts below it."""
    scored = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    if cuts is None:
        cuts = cut_points(scored, score)
    counts = score_counts(scored, keys, label, score)
    return running_totals(counts, keys, score, ["pos", "neg"], cuts)


def hash_order(df: DataFrame, strata: list[str], row_id: str, seed: int, out: str = "__rank",
               buckets: int | None = None) -> DataFrame:
    """0-based position of every row inside its stratum in md5 order.

    Buckets are equal ranges of the digest's leading 32 bits, as many as there are
    shuffle partitions, or as asked.  A digest is uniform whatever the ids look like,
    so a stratum that holds most of the rows is still split evenly; the buckets'
    sizes give the offsets.
    """
    if buckets is None:
        buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed = df.withColumn("__h", F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed)))))
    stand_ins = _never_null(df, strata)
    hashed = hashed.withColumns({BUCKET: F.coalesce(F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32), F.lit(-1)), **stand_ins})
    on = [*stand_ins, BUCKET]
    sizes = hashed.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*stand_ins).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*on, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = W.partitionBy(*on).orderBy("__h", row_id)
    ranked = hashed.withColumn("__l", F.row_number().over(inside) - 1)
    return ranked.join(offsets, on).select(*df.columns, (F.col("__l") + F.col("__o")).alias(out))
