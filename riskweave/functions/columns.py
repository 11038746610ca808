"""Scalar building blocks as Spark column expressions.

Missing is always NULL.  Spark orders NaN above every number and counts it as
present, so every numeric entry point below turns NaN into NULL first.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from riskweave.functions import fixed


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning ----------------------------------------------------------------

def drop_token(c, token: str = fixed.MISSING_TOKEN) -> Column:
    """Text with the missing-value token turned into NULL."""
    return F.nullif(F.trim(as_column(c)), F.lit(token))


def drop_nan(c) -> Column:
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def to_number(c, token: str | None = None) -> Column:
    """Tolerant text-to-double: text that is no number becomes NULL, and so does ``token``.

    The JVM number parser also takes Java literals such as ``1.5d``; those are
    not numbers in a data file, hence the guard.  It is one pattern over the untrimmed
    text (the cast trims), so that the generated code names a column twice only: with
    each step nested in the next, a scan of 14 columns was too long to be compiled.
    """
    text = as_column(c)
    literal = r"^ *[+-]?0[xX]|[0-9.][dDfF](?:\r\n|[\n\r\u0085\u2028\u2029])? *\z|[nN][aA][nN]"
    if token is not None:
        literal += "|^ *" + re.escape(token) + r" *\z"
    return F.when(~text.rlike(literal), text.try_cast("double"))


def zero_to_missing(value, site, trusted: str = fixed.TRUSTED_SITE) -> Column:
    """NULL where a zero was recorded at any site but the trusted one."""
    value, site = as_column(value), as_column(site)
    return F.when((site != trusted) & (value == 0), None).otherwise(value)


def binarize(c) -> Column:
    """1 where the value is above zero, else 0; a missing value counts as 0."""
    return F.coalesce(drop_nan(as_column(c).cast("double")) > 0, F.lit(False)).cast("int")


def strict_int(c, name: str = "value") -> Column:
    """Integer that must be present: a missing value fails the job."""
    c = as_column(c)
    checked = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{name} is missing")).cast("double"))
    return checked.cast("int")


# --- bands and labels --------------------------------------------------------

def steps(value, edges: list[float], labels: list, right_closed: bool = False) -> Column:
    """Label of the interval a value falls into; NULL stays NULL."""
    value = as_column(value)
    below = (lambda e: value <= e) if right_closed else (lambda e: value < e)
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(below(edge), label) if out is None else out.when(below(edge), label)
    return F.when(value.isNotNull(), out.otherwise(labels[-1]))


def age_band(age) -> Column:
    edges = [upper for upper, _ in fixed.AGE_BAND_UPPER]
    labels = [label for _, label in fixed.AGE_BAND_UPPER] + [fixed.AGE_BAND_LAST]
    return steps(age, edges, labels, right_closed=True)


def sex_label(sex) -> Column:
    """Readable code; an unmapped code is shown as it is."""
    sex = as_column(sex)
    mapped = reduce(
        lambda acc, kv: acc.when(sex == kv[0], kv[1]),
        list(fixed.SEX_LABELS.items())[1:],
        F.when(sex == 0, fixed.SEX_LABELS[0]),
    )
    return F.coalesce(mapped, sex.cast("string"))


def risk_level(p) -> Column:
    return steps(p, [fixed.RISK_LOW_BELOW, fixed.RISK_MODERATE_BELOW], fixed.RISK_LABELS)


def interior_edges(n_bins: int) -> list[float]:
    """Inner edges of ``n_bins`` equal bins over [0, 1], as double products.

    ``3 * 0.1`` is not ``0.3`` in double arithmetic; a score of exactly 0.3 must
    land in the bin the product puts it in.
    """
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def bin_left_closed(p, n_bins: int) -> Column:
    """Bin index with ``[lo, hi)`` bins, the last one closed; NULL outside [0, 1]."""
    p = as_column(p)
    inside = p.between(0.0, 1.0)
    return F.when(inside, reduce(lambda a, e: a + (p >= e).cast("int"), interior_edges(n_bins), F.lit(0)))


def bin_right_closed(p, n_bins: int) -> Column:
    """Bin index with ``(lo, hi]`` bins, the first one closed; NULL outside [0, 1]."""
    p = as_column(p)
    inside = p.between(0.0, 1.0)
    return F.when(inside, reduce(lambda a, e: a + (p > e).cast("int"), interior_edges(n_bins), F.lit(0)))


# --- agreement ---------------------------------------------------------------

def spread(*probabilities) -> Column:
    """Population standard deviation of a few columns of one row."""
    cols = [as_column(p) for p in probabilities]
    n = float(len(cols))
    mean = reduce(lambda a, b: a + b, cols) / F.lit(n)
    return F.sqrt(reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cols]) / F.lit(n))


def agreement_level(std, high: float = fixed.AGREE_HIGH_BELOW, low: float = fixed.AGREE_MODERATE_BELOW) -> Column:
    return steps(std, [high, low], fixed.AGREE_LEVELS)


def whole_percent(p) -> Column:
    """Integer percent, halves to even."""
    return F.rint(as_column(p) * 100.0).cast("int")


def agreement_flag(rf, xgb, ada, level) -> Column:
    level = as_column(level)
    note = F.when(level == fixed.AGREE_LEVELS[0], fixed.AGREE_NOTES[fixed.AGREE_LEVELS[0]])
    for name in fixed.AGREE_LEVELS[1:]:
        note = note.when(level == name, fixed.AGREE_NOTES[name])
    return F.concat(
        F.lit("Model agreement: "), level,
        F.lit(" — RF: "), whole_percent(rf).cast("string"),
        F.lit("%, XGBoost: "), whole_percent(xgb).cast("string"),
        F.lit("%, AdaBoost: "), whole_percent(ada).cast("string"),
        F.lit("%."), note,
    )


# --- ratios and text ---------------------------------------------------------

def ratio(num, den, when_undefined=None) -> Column:
    """num / den as double; ``when_undefined`` where the denominator is zero."""
    out = F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))
    return out if when_undefined is None else F.coalesce(out, F.lit(when_undefined))


def percent_text(p, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", tie_even(as_column(p) * 100.0, digits))


def tie_even(x, digits: int = 1) -> Column:
    """``x`` rounded to one place, ties of its exact binary value to even.

    ``x * 10`` loses what does not fit a double; that remainder (two-sum of 8x and 2x)
    tells a true tie from a value just beside one.  No or several digits are rounded
    without it.
    """
    x = as_column(x).cast("double")
    if digits != 1:
        return F.bround(x, digits)
    a, b = x * 8.0, x * 2.0
    total = a + b
    back = total - a
    lost = (a - (total - back)) + (b - back)
    low = F.floor(total).cast("double")
    tie = total - low == 0.5
    return F.when(tie & (lost > 0), low + 1).when(tie & (lost < 0), low).otherwise(F.rint(total)) / 10.0


def relative_change(new, original) -> Column:
    """|new - original| over the original, which counts as 1 when it is 0.

    The denominator keeps its sign, so a negative original gives a negative
    change.
    """
    new, original = as_column(new), as_column(original)
    return F.abs(new - original) / F.when(original != 0, original).otherwise(F.lit(1.0))


def grid_value(start, stop, step, n_steps: int) -> Column:
    """Value ``step`` (0-based) of ``n_steps`` even steps from start to stop."""
    start, stop, step = as_column(start), as_column(stop), as_column(step)
    walked = start + step.cast("double") * ((stop - start) / F.lit(float(n_steps - 1)))
    return F.when(step == n_steps - 1, stop).otherwise(walked)


def actionable_bound(feature: str, original) -> Column:
    """Where the search for ``feature`` ends, given the row's own value."""
    original = as_column(original)
    if feature not in fixed.ACTIONABLE:
        return original * F.lit(fixed.ACTIONABLE_DEFAULT_RATIO)
    direction, clamp, factor = fixed.ACTIONABLE[feature]
    if factor == 0.0:
        return F.lit(clamp)
    pick = F.greatest if direction == "down" else F.least
    return pick(F.lit(clamp), original * F.lit(factor))


def impact_text(value) -> Column:
    up, down = fixed.IMPACT_TEXTS
    return F.when(as_column(value) > 0, up).otherwise(down)


def overlap_ratio(a, b, k: int) -> Column:
    """Shared members of the first ``k`` of two ordered arrays, over ``k``."""
    a, b = F.slice(as_column(a), 1, k), F.slice(as_column(b), 1, k)
    return F.size(F.array_intersect(a, b)) / F.lit(float(k))


def overlap_label(ratio_col) -> Column:
    return F.when(as_column(ratio_col) >= fixed.OVERLAP_STRONG_FROM, fixed.OVERLAP_LABELS[0]).otherwise(
        fixed.OVERLAP_LABELS[1]
    )


def rule_feature(rule, names: list[str]) -> Column:
    """First listed name that occurs in the rule text, else the rule itself."""
    rule = as_column(rule)
    return F.coalesce(*[F.when(F.contains(rule, F.lit(n)), F.lit(n)) for n in names], rule)


# --- reproducible randomness -------------------------------------------------

def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[as_column(p).cast("string") for p in parts]))


def unit_uniform(*parts) -> Column:
    """A number in [0, 1) that depends only on the given values."""
    head = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
