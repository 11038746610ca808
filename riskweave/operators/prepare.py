"""Impute, scale and encode: fitted on some rows, applied to any.

A fit is a small statistics table.  Fold-wise fits never replicate the rows:
every fold contributes partial moments once, and the training statistics of fold
``f`` are merged from the partials of the other folds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.functions import fixed
from riskweave.operators import cleaning, ranks

# relative rank error of the quantile sketch behind the exact median
_SKETCH = 10000
_MARGIN = 2.0 / _SKETCH


@dataclass
class FeatureStats:
    """Statistics of one feature in one fit; ``fill`` is NULL when all was missing."""

    fill: float | None
    mean: float | None = None
    std: float | None = None
    categories: list = field(default_factory=list)


@dataclass
class Preparation:
    """Fitted statistics: ``stats[fold][feature]``; an unfolded fit has fold None."""

    numeric: list[str]
    categorical: list[str]
    stats: dict

    # --- names ---------------------------------------------------------------

    def dropped(self, fold=None) -> list[str]:
        """Features with no value at all when fitted; they are left out."""
        return [f for f in [*self.numeric, *self.categorical] if self.stats[fold][f].fill is None]

    def feature_names(self, fold=None) -> list[str]:
        gone = set(self.dropped(fold))
        names = [f for f in self.numeric if f not in gone]
        for f in self.categorical:
            if f not in gone:
                names += [f"{f}_{_category_text(v)}" for v in self.stats[fold][f].categories]
        return names

    # --- apply ---------------------------------------------------------------

    def columns(self, fold=None, scale: bool = True) -> list[Column]:
        """Prepared feature columns of one fit: literals only, so applying a fit
        is a map-side projection without any join."""
        gone = set(self.dropped(fold))
        out = []
        for f in self.numeric:
            if f in gone:
                continue
            s = self.stats[fold][f]
            value = F.coalesce(F.col(f).cast("double"), F.lit(s.fill))
            if scale:
                value = (value - F.lit(s.mean)) / F.lit(s.std if s.std else 1.0)
            out.append(value.alias(f))
        for f in self.categorical:
            if f in gone:
                continue
            s = self.stats[fold][f]
            value = F.coalesce(F.col(f), F.lit(s.fill))
            for v in s.categories:
                hit = F.coalesce(value == F.lit(v), F.lit(False)).cast("double")
                out.append(hit.alias(f"{f}_{_category_text(v)}"))
        return out

    def transform(self, df: DataFrame, keep: list[str] = (), fold=None, scale: bool = True) -> DataFrame:
        return df.select(*keep, *self.columns(fold, scale))

    def transform_folds(self, df: DataFrame, keep: list[str], fold_col: str = "fold",
                        scale: bool = True) -> DataFrame:
        """Every row prepared with the fit of its own (held-out) fold.

        The statistics are ``k`` rows by construction, small enough to send to
        every task whatever the size of ``df``.
        """
        stats = self._wide(df.sparkSession).withColumnRenamed("fold", "__fold")
        joined = df.join(F.broadcast(stats), F.col(fold_col) == F.col("__fold"))
        out = []
        for f in self.numeric:
            value = F.coalesce(F.col(f).cast("double"), F.col(f"__fill_{f}"))
            if scale:
                std = F.col(f"__std_{f}")
                value = (value - F.col(f"__mean_{f}")) / F.when(std == 0, 1.0).otherwise(std)
            out.append(value.alias(f))
        for f in self.categorical:
            value = F.col(f) if self._is_text(f) else F.col(f).cast("double")
            out.append(F.coalesce(value, F.col(f"__fill_{f}")).alias(f))
        return joined.select(*keep, *out)

    def _is_text(self, feature: str) -> bool:
        return any(isinstance(by[feature].fill, str) for by in self.stats.values())

    def _wide(self, spark: SparkSession) -> DataFrame:
        rows, names = [], [*self.numeric, *self.categorical]
        for fold, by_feature in sorted(self.stats.items()):
            row = [int(fold)]
            for f in names:
                s = by_feature[f]
                fill = s.fill if self._is_text(f) else _number(s.fill)
                row += [fill, _number(s.mean), _number(s.std)]
            rows.append(tuple(row))
        cols = ", ".join(
            f"`__fill_{f}` {'string' if self._is_text(f) else 'double'}, `__mean_{f}` double, `__std_{f}` double"
            for f in names
        )
        return spark.createDataFrame(rows, f"fold int, {cols}")

    # --- as data -------------------------------------------------------------

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The statistics table, one row per (fold, feature).

        ``fill`` is NULL for a text category, which is in ``fill_json``.
        """
        rows = []
        for fold, by_feature in self.stats.items():
            for position, f in enumerate([*self.numeric, *self.categorical]):
                s = by_feature[f]
                role = "numeric" if f in self.numeric else "categorical"
                fill = None if isinstance(s.fill, str) else _number(s.fill)
                rows.append((None if fold is None else int(fold), f, role, fill, _number(s.mean), _number(s.std),
                             json.dumps(s.fill), json.dumps(s.categories), position))
        return spark.createDataFrame(rows, (
            "fold int, feature string, role string, fill double, mean double, std double, "
            "fill_json string, categories string, position int"
        ))

    @classmethod
    def from_frame(cls, df: DataFrame) -> "Preparation":
        numeric, categorical, stats = [], [], {}
        # the order of the features is the order of the model's inputs
        for r in df.orderBy("fold", "position").collect():
            names = numeric if r["role"] == "numeric" else categorical
            if r["feature"] not in names:
                names.append(r["feature"])
            stats.setdefault(r["fold"], {})[r["feature"]] = FeatureStats(
                json.loads(r["fill_json"]), r["mean"], r["std"], json.loads(r["categories"])
            )
        return cls(numeric, categorical, stats)


def _number(v):
    return None if v is None else float(v)


def _category_text(v) -> str:
    """A category as it is: a double 1 is ``1.0``, an integer 1 is ``1``."""
    return str(v)


# --- fitting -----------------------------------------------------------------

def fit(df: DataFrame, numeric: list[str], categorical: list[str] = (), fold_col: str | None = None,
        k: int | None = None, one_hot: bool = True, max_categories: int | None = None) -> Preparation:
    """Fit medians, modes, means, population deviations and categories.

    With ``fold_col`` (values 0..k-1) one fit per fold, each from the rows of the
    other folds.  Numeric features take three narrow passes (moments and sketch,
    counts below, the few values around the median), categorical ones two.  Fold
    numbers come out of a shuffle, so a fold-wise fit keeps the columns it needs
    while it runs; a plain fit reads the scan again.  ``one_hot=False`` fits modes
    without their list of categories, for imputation of any number of values;
    ``max_categories`` refuses longer lists where a caller wants that.
    """
    if fold_col is not None and k is None:
        k = df.select(F.max(fold_col)).first()[0] + 1
    fits = [None] if fold_col is None else list(range(k))
    stats = {f: {} for f in fits}
    if fold_col is not None:
        df = df.select(fold_col, *numeric, *categorical).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if numeric:
            _fit_numeric(df, list(numeric), fold_col, fits, stats)
        if categorical:
            types = dict(df.dtypes)
            for kind, cast in (("text", "string"), ("whole", "long"), ("number", "double")):
                names = [c for c in categorical if _kind(types[c]) == kind]
                if names:
                    _fit_categorical(df, names, cast, fold_col, fits, stats, one_hot, max_categories)
    finally:
        if fold_col is not None:
            df.unpersist()
    return Preparation(list(numeric), list(categorical), stats)


def _fit_numeric(df, names, fold_col, fits, stats) -> None:
    """One pass: per fold (or once) moments, missing counts and a median sketch.

    The median of a union lies between the smallest and the largest median of
    its parts, so the sketches of the folds bracket every training median.
    """
    keys = [] if fold_col is None else [fold_col]
    aggs = []
    for j, f in enumerate(names):
        x = F.col(f).cast("double")
        aggs += [
            F.count(x).alias(f"n_{j}"), F.avg(x).alias(f"m_{j}"), F.var_pop(x).alias(f"v_{j}"),
            F.count_if(x.isNull()).alias(f"z_{j}"),
            F.percentile_approx(x, [0.5 - _MARGIN, 0.5 + _MARGIN], _SKETCH).alias(f"q_{j}"),
        ]
    parts = {(r[fold_col] if fold_col else None): r for r in df.groupBy(*keys).agg(*aggs).collect()}
    brackets = {}
    for j in range(len(names)):
        pairs = [r[f"q_{j}"] for r in parts.values() if r[f"n_{j}"]]
        if pairs:
            brackets[j] = (min(q[0] for q in pairs), max(q[1] for q in pairs))
    sizes = {(p, j): r[f"n_{j}"] for p, r in parts.items() for j in range(len(names))}
    medians = _medians(df, names, fold_col, fits, brackets, sizes)
    for fold in fits:
        used = [r for p, r in parts.items() if fold_col is None or p != fold]
        for j, f in enumerate(names):
            median = medians.get((fold, j))
            moments = [(r[f"n_{j}"], r[f"m_{j}"], r[f"v_{j}"]) for r in used]
            if median is not None:
                moments.append((sum(r[f"z_{j}"] for r in used), median, 0.0))
            mean, std = _merge(moments)
            stats[fold][f] = FeatureStats(median, mean, std)


def _merge(moments: list[tuple]) -> tuple[float | None, float | None]:
    """Mean and population deviation of a union from (n, mean, variance) parts."""
    moments = [m for m in moments if m[0]]
    n = sum(m[0] for m in moments)
    if not n:
        return None, None
    mean = sum(c * m for c, m, _ in moments) / n
    var = sum(c * (v + (m - mean) ** 2) for c, m, v in moments) / n
    return mean, var ** 0.5


def _medians(df, names, fold_col, fits, brackets, sizes) -> dict:
    """Exact medians, the middle two averaged, per (fit, feature).

    What lies below a bracket is only counted; what lies inside is reduced to
    counts per distinct value and ranked.  A bracket that turns out not to hold
    a middle is widened to everything, so the sketch never decides a result.
    """
    out, todo = {}, dict(brackets)
    everything = (float("-inf"), float("inf"))
    while todo:
        found = _middle_values(df, names, fold_col, fits, todo, sizes)
        out.update(found)
        open_features = {
            j for j in todo for fold in fits
            if (fold, j) not in found and any(
                n for (p, jj), n in sizes.items() if jj == j and (fold_col is None or p != fold)
            )
        }
        if any(todo[j] == everything for j in open_features):
            raise ValueError("no median found for " + ", ".join(names[j] for j in sorted(open_features)))
        todo = {j: everything for j in open_features}
    return out


def _middle_values(df, names, fold_col, fits, todo, sizes) -> dict:
    keys = [] if fold_col is None else [fold_col]
    sides = []
    for j, (lo, hi) in todo.items():
        x = F.col(names[j]).cast("double")
        sides += [F.count_if(x < lo).alias(f"b_{j}"), F.count_if(x.between(lo, hi)).alias(f"i_{j}")]
    counted = {(r[fold_col] if fold_col else None): r for r in df.groupBy(*keys).agg(*sides).collect()}

    tagged = []
    for j, (lo, hi) in todo.items():
        x = F.col(names[j]).cast("double")
        tagged.append(F.when(x.between(lo, hi), F.struct(F.lit(j).alias("j"), x.alias("x"))))
    parts = list(counted)
    inside = (
        df.select(*keys, F.explode(F.array_compact(F.array(*tagged))).alias("t"))
        .groupBy("t.j", "t.x")
        .agg(*[
            F.count_if(F.lit(True) if p is None else F.col(fold_col) == F.lit(p)).alias(f"c_{i}")
            for i, p in enumerate(parts)
        ])
    )
    cuts = ranks.cut_points(inside, "x")
    measures = [f"c_{i}" for i in range(len(parts))]
    ranked = ranks.running_totals(inside, ["j"], "x", measures, cuts)
    picks, wanted = [], {}
    for a, fold in enumerate(fits):
        used = [i for i, p in enumerate(parts) if fold_col is None or p != fold]
        up_to = sum((F.col(f"below_c_{i}") + F.col(f"c_{i}") for i in used), F.lit(0))
        below = sum((F.col(f"below_c_{i}") for i in used), F.lit(0))
        for j in todo:
            n = sum(sizes[(parts[i], j)] for i in used)
            skip = sum(counted[parts[i]][f"b_{j}"] for i in used)
            if n:
                wanted[(fold, j)] = ((n + 1) // 2 - skip, n // 2 + 1 - skip)
                for side, rank in zip("ab", wanted[(fold, j)]):
                    hit = (F.col("j") == j) & (below < rank) & (up_to >= rank)
                    picks.append(F.max(F.when(hit, F.col("x"))).alias(f"{side}_{a}_{j}"))
    found = {}
    if picks:
        row = ranked.agg(*picks).first()
        for a, fold in enumerate(fits):
            for j in todo:
                if (fold, j) in wanted:
                    lo, hi = row[f"a_{a}_{j}"], row[f"b_{a}_{j}"]
                    if lo is not None and hi is not None:
                        found[(fold, j)] = (lo + hi) / 2.0
    return found


def _kind(type_name: str) -> str:
    if type_name in ("tinyint", "smallint", "int", "bigint"):
        return "whole"
    return "number" if type_name in ("float", "double") or type_name.startswith("decimal") else "text"


def _fit_categorical(df, names, cast, fold_col, fits, stats, one_hot, max_categories) -> None:
    """Modes (ties to the smallest) and sorted categories.

    The feature values are reduced to counts per (feature, value) with one count
    column per fold; a training count is the sum over the other folds.
    """
    parts = ", ".join(f"'{n}', cast(`{n}` as {cast})" for n in names)
    keep = [] if fold_col is None else [fold_col]
    long = df.select(*keep, F.expr(f"stack({len(names)}, {parts}) as (feature, value)"))
    counts = [
        F.count_if(F.lit(True) if fold is None else F.col(fold_col) != F.lit(fold)).alias(f"c_{i}")
        for i, fold in enumerate(fits)
    ]
    tally = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(*counts)
    picks = []
    for i in range(len(fits)):
        seen = F.when(F.col(f"c_{i}") > 0, F.col("value"))
        picks += [
            F.min_by("value", F.struct(-F.col(f"c_{i}"), F.col("value"))).alias(f"mode_{i}"),
            F.count(seen).alias(f"size_{i}"),
        ]
    summary = {r["feature"]: r for r in tally.groupBy("feature").agg(*picks).collect()}
    for f, r in summary.items():
        for i in range(len(fits)):
            if max_categories is not None and r[f"size_{i}"] > max_categories:
                raise ValueError(f"{f} has {r[f'size_{i}']} categories, more than {max_categories}")
    categories = {} if not one_hot else {
        r["feature"]: r for r in tally.groupBy("feature").agg(*[
            F.array_sort(F.collect_list(F.when(F.col(f"c_{i}") > 0, F.col("value")))).alias(f"all_{i}")
            for i in range(len(fits))
        ]).collect()
    }
    for i, fold in enumerate(fits):
        for f in names:
            if f not in summary or not summary[f][f"size_{i}"]:
                stats[fold][f] = FeatureStats(None)
            else:
                stats[fold][f] = FeatureStats(summary[f][f"mode_{i}"], categories=categories[f][f"all_{i}"] if one_hot else [])


def fit_cohort(df: DataFrame, roles: str = "dtype", **kw) -> Preparation:
    """Roles inferred, then fitted."""
    numeric, categorical = cleaning.infer_roles(df, roles)
    return fit(df, [c for c in numeric if c != "row_id"], [c for c in categorical if c != "row_id"], **kw)


def fit_harmonized(df: DataFrame, **kw) -> Preparation:
    """The common schema: all five features are treated as numeric."""
    return fit(df, fixed.COMMON_FEATURES, [], **kw)
