"""Grid search for the smallest change that takes a score below the threshold.

All rows run through one pipeline: the grid is exploded from a sequence next to
its row (never joined), scored in bulk by any scorer, and reduced to the first
flipping step per feature.  The only shuffle deals the rows out by ``row_id``, a
bounded number to each task; both stages and the final choice group by ``row_id``
and reuse that partitioning, so a task's memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave.functions import columns as C, fixed
from riskweave.session import enough_tasks

# adds the named probability column to a table of raw features, keeping the rest
Scorer = Callable[[DataFrame, str], DataFrame]

#: Rows of a task: the two-feature stage holds a group per first step of each pair, some 4 kB a row.
ROWS_PER_TASK = 30_000


def candidates(df: DataFrame, score: str, row_id: str = "row_id", low: float = fixed.CANDIDATE_RANGE[0],
               high: float = fixed.CANDIDATE_RANGE[1], count: int = fixed.CANDIDATE_COUNT,
               fallback: int = fixed.CANDIDATE_FALLBACK_ROWS) -> DataFrame:
    """The first few rows in the score range, or the first rows when none is.

    One top-n read (``TakeOrderedAndProject``): rows in the range first, then by
    id.  The windows that tell which case it is run over those few rows only.
    """
    hit = F.coalesce(F.col(score).between(low, high), F.lit(False))
    few = (
        df.withColumn("__hit", hit.cast("int")).orderBy(F.desc("__hit"), row_id).limit(max(count, fallback))
    )
    ordered = W.partitionBy(F.lit(0)).orderBy(F.desc("__hit"), row_id)
    marked = few.withColumns({
        "__any": F.max("__hit").over(W.partitionBy(F.lit(0))), "__k": F.row_number().over(ordered),
    })
    in_range = (F.col("__hit") == 1) & (F.col("__k") <= count)
    return marked.where(in_range | ((F.col("__any") == 0) & (F.col("__k") <= fallback))).drop("__hit", "__any", "__k")


def _moved(features: list[str], which: Column, step: Column, n_steps: int) -> dict:
    """Feature columns with the one named by ``which`` moved along its grid."""
    return {
        f: F.when(which == i, C.grid_value(f, C.actionable_bound(f, f), step, n_steps)).otherwise(F.col(f))
        for i, f in enumerate(features)
    }


def find(df: DataFrame, scorer: Scorer, row_id: str = "row_id", inputs: list[str] = fixed.FEATURE_COLUMNS,
         features: list[str] = tuple(fixed.ACTIONABLE), threshold: float = fixed.DECISION_THRESHOLD,
         steps: int = fixed.SINGLE_STEPS, dual_steps: int = fixed.DUAL_STEPS,
         rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per input row: initial score, whether it flips, and how.

    Per feature the first flipping step counts, and the smallest relative change
    over features wins, the earlier feature on ties.  Rows that no single feature
    flips are searched over feature pairs; there the first flipping second step
    counts per first step.
    """
    features = list(features)
    inputs = [c for c in inputs if c in df.columns]
    dealt = df.select(row_id, *inputs).repartition(enough_tasks(df, rows_per_task), row_id)
    base = scorer(dealt, "initial_prob")
    single = _single_stage(base, scorer, row_id, inputs, features, threshold, steps)
    dual = _dual_stage(single, scorer, row_id, inputs, features, threshold, dual_steps)
    return _final(dual, scorer, row_id, inputs, features, threshold, steps, dual_steps)


def _first(names: list[str]):
    return [F.any_value(c).alias(c) for c in names]


def _single_stage(base, scorer, row_id, inputs, features, threshold, steps):
    last = len(features) * steps - 1
    points = base.withColumn(
        "__point",
        F.explode_outer(F.when(F.col("initial_prob") > threshold, F.sequence(F.lit(0), F.lit(last)))),
    )
    which, step = F.floor(F.col("__point") / F.lit(steps)).cast("int"), F.pmod("__point", F.lit(steps))
    points = points.withColumns({"__which": which, "__step": step})
    originals = {f"__orig_{f}": F.col(f) for f in features}
    moved = points.withColumns(originals).withColumns(
        _moved(features, F.col("__which"), F.col("__step"), steps)
    )
    # low-risk rows carry no point and need no second score
    scored = scorer(moved, "__p").withColumns({f: F.col(f"__orig_{f}") for f in features})
    flips = F.col("__p") < threshold
    return scored.groupBy(row_id).agg(
        *_first(["initial_prob", *inputs]),
        *[
            F.min(F.when(flips & (F.col("__which") == i) & F.col(f).isNotNull(), F.col("__step"))).alias(f"__s_{f}")
            for i, f in enumerate(features)
        ],
    )


def _best_single(features: list[str], steps: int) -> Column:
    """Struct (pct, feature index, step) of the least change, NULL without a hit."""
    options = []
    for i, f in enumerate(features):
        s = F.col(f"__s_{f}")
        value = C.grid_value(f, C.actionable_bound(f, f), s, steps)
        options.append(F.when(s.isNotNull(), F.struct(
            C.relative_change(value, f).alias("pct"), F.lit(i).alias("which"), s.alias("step")
        )))
    return F.array_min(F.array_compact(F.array(*options)))


def _dual_stage(single, scorer, row_id, inputs, features, threshold, steps):
    pairs = list(combinations(range(len(features)), 2))
    carried = ["initial_prob", *inputs, *[f"__s_{f}" for f in features]]
    unhit = F.col("initial_prob") > threshold
    for f in features:
        unhit = unhit & F.col(f"__s_{f}").isNull()
    last = len(pairs) * steps * steps - 1
    if last < 0:
        return single.withColumn("__dual", F.lit(None).cast("struct<pct:double,pair:int,i:int,j:int>"))
    points = single.withColumn(
        "__point", F.explode_outer(F.when(unhit, F.sequence(F.lit(0), F.lit(last))))
    ).withColumns({
        "__pair": F.floor(F.col("__point") / F.lit(steps * steps)).cast("int"),
        "__i": F.pmod(F.floor(F.col("__point") / F.lit(steps)), F.lit(steps)).cast("int"),
        "__j": F.pmod(F.col("__point"), F.lit(steps)).cast("int"),
    })
    originals = points.withColumns({f"__orig_{f}": F.col(f) for f in features})
    moved, usable, change = {}, F.lit(False), {}
    for k, f in enumerate(features):
        value = F.col(f)
        for n, (a, b) in enumerate(pairs):
            if k in (a, b):
                step = F.col("__i") if k == a else F.col("__j")
                value = F.when(
                    F.col("__pair") == n, C.grid_value(f, C.actionable_bound(f, f), step, steps)
                ).otherwise(value)
        moved[f] = value
    for n, (a, b) in enumerate(pairs):
        here = F.col("__pair") == n
        usable = usable | (
            here & F.col(f"__orig_{features[a]}").isNotNull() & F.col(f"__orig_{features[b]}").isNotNull()
        )
    scored = scorer(originals.withColumns(moved), "__p").withColumns({f: F.col(f"__orig_{f}") for f in features})
    hit = (F.col("__p") < threshold) & usable
    per_first = scored.groupBy(row_id, "__pair", "__i").agg(
        *_first(carried), F.min(F.when(hit, F.col("__j"))).alias("__j")
    )
    pct = F.lit(None).cast("double")
    for n, (a, b) in enumerate(pairs):
        fa, fb = features[a], features[b]
        va = C.grid_value(fa, C.actionable_bound(fa, fa), F.col("__i"), steps)
        vb = C.grid_value(fb, C.actionable_bound(fb, fb), F.col("__j"), steps)
        pct = F.when(F.col("__pair") == n, C.relative_change(va, fa) + C.relative_change(vb, fb)).otherwise(pct)
    option = F.when(F.col("__j").isNotNull(), F.struct(
        pct.alias("pct"), F.col("__pair").alias("pair"), F.col("__i").alias("i"), F.col("__j").alias("j")
    ))
    return per_first.groupBy(row_id).agg(*_first(carried), F.min(option).alias("__dual"))


def _final(rows, scorer, row_id, inputs, features, threshold, steps, dual_steps):
    pairs = list(combinations(range(len(features)), 2))
    rows = rows.withColumn("__single", _best_single(features, steps))
    single, dual = F.col("__single"), F.col("__dual")
    originals = rows.withColumns({f"__orig_{f}": F.col(f) for f in features})
    moved = {}
    for k, f in enumerate(features):
        bound = C.actionable_bound(f, f)
        value = F.when(single["which"] == k, C.grid_value(f, bound, single["step"], steps))
        for n, (a, b) in enumerate(pairs):
            if k in (a, b):
                step = dual["i"] if k == a else dual["j"]
                value = value.when(
                    single.isNull() & (dual["pair"] == n), C.grid_value(f, bound, step, dual_steps)
                )
        moved[f] = value.otherwise(F.col(f))
    scored = scorer(originals.withColumns(moved), "__p")

    def at(array: Column, index: Column) -> Column:
        # element_at takes a NULL index for a number when the array has no NULLs
        return F.when(index.isNotNull(), F.element_at(array, index + 1))

    names = F.array(*[F.lit(f) for f in features])
    firsts = F.array(*[F.lit(a) for a, _ in pairs]) if pairs else F.array(F.lit(0))
    seconds = F.array(*[F.lit(b) for _, b in pairs]) if pairs else F.array(F.lit(0))
    one = F.when(single.isNotNull(), single["which"]).otherwise(at(firsts, dual["pair"]))
    two = F.when(single.isNull(), at(seconds, dual["pair"]))

    def pick(index: Column, prefix: str) -> Column:
        out = None
        for k, f in enumerate(features):
            out = F.when(index == k, F.col(prefix + f)) if out is None else out.when(index == k, F.col(prefix + f))
        return out

    flipped = single.isNotNull() | dual.isNotNull()
    details = F.when(flipped, F.struct(
        F.when(single.isNotNull(), "single").otherwise("dual").alias("type"),
        at(names, one).alias("f1"), pick(one, "__orig_").alias("orig_v1"), pick(one, "").alias("new_v1"),
        at(names, two).alias("f2"), pick(two, "__orig_").alias("orig_v2"), pick(two, "").alias("new_v2"),
        F.col("__p").alias("mod_prob"),
        F.coalesce(single["pct"], dual["pct"]).alias("pct_change"),
    ))
    out = scored.select(
        row_id, "initial_prob", flipped.alias("flipped"), details.alias("details"),
    )
    return out.withColumns({
        "statement": statement(features, threshold), "disclaimer": F.lit(fixed.WHAT_IF_DISCLAIMER),
    })


def statement(features: list[str], threshold: float) -> Column:
    """The what-if sentence of a row: flipped by one or two features, already
    low, or not flipped."""
    d, p0 = F.col("details"), F.col("initial_prob")
    texts, limit = fixed.WHAT_IF_TEXTS, C.tie_even(F.lit(threshold * 100.0), 0)
    first = [d["f1"], C.tie_even(d["orig_v1"]), C.tie_even(d["new_v1"])]
    second = [d["f2"], C.tie_even(d["orig_v2"]), C.tie_even(d["new_v2"])]
    drop = [C.tie_even(p0 * 100.0), C.tie_even(d["mod_prob"] * 100.0), limit]
    listed = F.lit("[" + ", ".join(f"'{f}'" for f in features) + "]")
    return (
        F.when(d["type"] == "single", F.format_string(texts["single"], *first, *drop))
        .when(d["type"] == "dual", F.format_string(texts["dual"], *first, *second, *drop))
        .when(p0 <= threshold, F.format_string(texts["low"], C.tie_even(p0 * 100.0)))
        .otherwise(F.format_string(texts["none"], listed, limit))
    )


def flat(found: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Details as plain columns."""
    return found.select(row_id, "initial_prob", "flipped", "details.*", "statement")
