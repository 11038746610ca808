"""Row-local cleaning, completion and domain checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from riskweave.functions import columns as C, fixed

_FLOATING = (T.DoubleType, T.FloatType)
_NUMERIC = (T.NumericType,)


def numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as double: token and bad text become NULL.

    Only text columns pay for text handling; numeric ones are cast, and
    floating ones lose their NaNs.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def convert(name: str):
        if isinstance(types[name], T.StringType):
            return C.to_number(name, fixed.MISSING_TOKEN)
        if isinstance(types[name], _FLOATING):
            return C.drop_nan(F.col(name).cast("double"))
        return F.col(name).cast("double")

    return df.withColumns({n: convert(n) for n in names if n in types})


def zeros_to_missing(df: DataFrame, names: list[str] = fixed.ZERO_IS_MISSING, site: str = fixed.SITE,
                     trusted: str = fixed.TRUSTED_SITE) -> DataFrame:
    """Apply the site rule to the named columns; without a site column, nothing."""
    if site not in df.columns:
        return df
    return df.withColumns({n: C.zero_to_missing(n, site, trusted) for n in names if n in df.columns})


def clean_cohort(df: DataFrame, trusted: str = fixed.TRUSTED_SITE) -> DataFrame:
    """Cast, apply the zero rule and binarise the target of a tagged cohort.

    Four projections that Catalyst collapses into the scan's stage.
    """
    out = zeros_to_missing(numeric(df, fixed.COHORT_COLUMNS), trusted=trusted)
    return out.withColumn(fixed.TARGET, C.binarize(fixed.TARGET)) if fixed.TARGET in out.columns else out


def clean_site(df: DataFrame, site: str, trusted: str = fixed.TRUSTED_SITE) -> DataFrame:
    return clean_cohort(df.withColumn(fixed.SITE, F.lit(site)), trusted=trusted)


def drop_roles(df: DataFrame, names: list[str] = (fixed.TARGET, fixed.SITE)) -> DataFrame:
    """Features only: target and provenance dropped where present."""
    return df.drop(*names)


def complete(df: DataFrame, names: list[str] = fixed.FEATURE_COLUMNS, keep: list[str] = ()) -> DataFrame:
    """Exactly the wanted columns in order; absent ones are NULL, extras go."""
    have = set(df.columns)
    return df.select(
        *[c for c in keep if c in have],
        *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in names],
    )


def infer_roles(df: DataFrame, mode: str = "dtype",
                exclude: tuple[str, ...] = (fixed.TARGET, fixed.SITE)) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names.

    ``dtype``: numeric when listed as such or floating.  ``declared``: the fixed
    split, restricted to the columns at hand.
    """
    fields = [f for f in df.schema.fields if f.name not in exclude]
    if mode == "declared":
        names = {f.name for f in fields}
        return ([c for c in fixed.DECLARED_NUMERIC if c in names],
                [c for c in fixed.DECLARED_CATEGORICAL if c in names])
    num = [f.name for f in fields if f.name in fixed.ALWAYS_NUMERIC or isinstance(f.dataType, _FLOATING)]
    return num, [f.name for f in fields if f.name not in num]


def code_labels(df: DataFrame, table: dict[str, dict[str, float]] = fixed.CODE_TABLE) -> DataFrame:
    """Form labels to codes.  The tables have a handful of fixed entries, so each
    is a literal in the plan, not a join; an unknown label becomes NULL."""
    def code(name: str):
        out = None
        for label, value in table[name].items():
            hit = F.col(name) == label
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    return df.withColumns({n: code(n) for n in table if n in df.columns})


def domain_report(df: DataFrame, keys: list[str] = (),
                  bounds: dict[str, tuple[float, float]] = fixed.DOMAIN_BOUNDS) -> DataFrame:
    """Rows inside, outside and missing per bounded column (long form).

    One pass with partial aggregation; the tiny result is then unpivoted.
    """
    names = [n for n in bounds if n in df.columns]
    aggs = []
    for n in names:
        lo, hi = bounds[n]
        aggs += [
            F.count_if(F.col(n).between(lo, hi)).alias(f"{n}__valid"),
            F.count_if(~F.col(n).between(lo, hi)).alias(f"{n}__invalid"),
            F.count_if(F.col(n).isNull()).alias(f"{n}__missing"),
        ]
    wide = df.groupBy(*keys).agg(*aggs)
    parts = ", ".join(f"'{n}', `{n}__valid`, `{n}__invalid`, `{n}__missing`" for n in names)
    return wide.select(*keys, F.expr(f"stack({len(names)}, {parts}) as (feature, n_valid, n_invalid, n_missing)"))
