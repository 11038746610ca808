"""Attributions and local surrogates as batch jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from riskweave.functions import columns as C, fixed
from riskweave.operators import boosting, forests, learners

Scorer = Callable[[DataFrame, str], DataFrame]
SHORT = 6               # conditions of a leaf whose patterns are all looked up in a table


# --- exact Shapley values of any scorer --------------------------------------

def shapley(df: DataFrame, scorer: Scorer, features: list[str], reference: dict[str, float],
            row_id: str = "row_id", keep: list[str] = ()) -> DataFrame:
    """Exact Shapley values against one reference input, for few features.

    Every row is exploded into its ``2^d`` coalitions beside itself, scored in
    bulk, and summed back with the coalition weights; the partial sums collapse
    the explosion inside the task, so one row per input row is shuffled.  The work
    doubles with each feature; trees have a cheaper form below.  Adds
    ``base`` (score of the reference), ``p`` and one column per feature;
    ``base + sum = p``.
    """
    d = len(features)
    full = 2 ** d - 1
    masks = df.withColumn("__mask", F.explode(F.sequence(F.lit(0), F.lit(full))))
    inside = {f: F.getbit(F.col("__mask"), F.lit(i)) == 1 for i, f in enumerate(features)}
    mixed = masks.withColumns({
        f: F.when(inside[f], F.col(f)).otherwise(F.lit(float(reference[f]))) for f in features
    })
    scored = scorer(mixed, "__p")
    fact = math.factorial
    joins = [fact(s) * fact(d - s - 1) / fact(d) for s in range(d)] + [0.0]
    weights = F.array(*[F.lit(w) for w in joins])
    size = F.bit_count("__mask")
    sums = []
    for f in features:
        # with f inside, the coalition without it has one member less
        w = F.when(inside[f], F.element_at(weights, F.greatest(size, F.lit(1)))).otherwise(
            -F.element_at(weights, size + 1)
        )
        sums.append(F.sum(w * F.col("__p")).alias(f))
    return scored.groupBy(row_id, *keep).agg(
        F.max(F.when(F.col("__mask") == 0, F.col("__p"))).alias("base"),
        F.max(F.when(F.col("__mask") == full, F.col("__p"))).alias("p"),
        *sums,
    )


# --- tree ensembles ----------------------------------------------------------

def tree_paths(model: learners.TreeModel | forests.Forest | boosting.Boosted) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves as (weighted value, [(feature, low, high, share)]).

    ``share`` is the part of training rows that follow the path at the splits on
    that feature; rows count by their hessian in boosted trees.  Size: trees times leaves, set by the model's parameters and
    independent of the data scored.  Values are probabilities for a forest and
    log-odds for boosted trees.
    """
    leaves = []

    def narrowed(path, f, t, is_left, share):
        lo, hi, r = path.get(f, (-math.inf, math.inf, 1.0))
        return {**path, f: (lo, min(hi, t), r * share) if is_left else (max(lo, t), hi, r * share)}

    def leaf(value, path):
        leaves.append((value, [(f, lo, hi, r) for f, (lo, hi, r) in path.items()]))

    def walk_forest(node, weight, path):
        if node.getClass().getSimpleName() != "InternalNode":
            stats = list(node.impurityStats().stats())
            leaf(weight * (stats[1] / sum(stats) if sum(stats) else 0.0), path)
            return
        split = node.split()
        here = float(node.impurityStats().count())
        for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
            share = float(child.impurityStats().count()) / here
            walk_forest(child, weight, narrowed(path, split.featureIndex(), split.threshold(), is_left, share))

    def walk_boosted(tree, node, path):
        if node not in tree.split:
            leaf(tree.value[node], path)
            return
        f, cut = tree.split[node]
        both = [tree.cover[2 * node + 1], tree.cover[2 * node + 2]]
        for child, is_left, h in ((2 * node + 1, True, both[0]), (2 * node + 2, False, both[1])):
            walk_boosted(tree, child, narrowed(path, f, model.cuts[f][cut], is_left, h / sum(both)))

    def walk_array(tree, node, weight, path):
        left = int(tree.left[node])
        if left == node:
            leaf(weight * float(tree.value[node]), path)
            return
        f, t = int(tree.feature[node]), model.cuts[tree.feature[node]][tree.bin[node]]
        for child, is_left in ((left, True), (left + 1, False)):
            walk_array(tree, child, weight, narrowed(path, f, t, is_left, float(tree.count[child] / tree.count[node])))

    if isinstance(model, forests.Forest):
        for tree in model.trees:
            walk_array(tree, 0, 1.0 / len(model.trees), {})
    elif model.kind == "random_forest":
        trees = list(model.model.trees)
        for tree in trees:
            walk_forest(tree._call_java("rootNode"), 1.0 / len(trees), {})
    else:
        for tree in model.trees:
            walk_boosted(tree, 0, {})
    return leaves


def leaf_shares(path: list[tuple[int, float, float, float]], on: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1, one column per condition, for rows of satisfied conditions ``on``.

    A condition's value is the sum over subset sizes of the polynomial that the other conditions span.
    """
    m = len(path)
    out = np.zeros(on.shape)
    for i in range(m):
        poly = [np.ones(len(on))]
        for j in range(m):
            if j != i:
                grown = [path[j][3] * c for c in poly] + [np.zeros(len(on))]
                for s, c in enumerate(poly):
                    grown[s + 1] = grown[s + 1] + on[:, j] * c
                poly = grown
        weight = sum(c * (math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)) for s, c in enumerate(poly))
        out[:, i] = (on[:, i] - path[i][3]) * weight
    return out


def tree_attribution(df: DataFrame, model: learners.TreeModel | forests.Forest | boosting.Boosted, keep: list[str]) -> DataFrame:
    """Path-dependent Shapley values of a tree ensemble, one column per feature
    plus ``base``.

    A leaf is a product of conditions, and its Shapley values depend on a row only by which
    conditions the row satisfies.  A batch's rows are packed to one bit pattern per leaf, the
    values are computed once per pattern that occurs (of leaves with up to ``SHORT`` conditions: of all patterns), and looked up by pattern.
    """
    names, leaves, shares, few = list(model.names), tree_paths(model), leaf_shares, SHORT
    assembled = learners.assemble(df, names).select(*keep, vector_to_array(learners.FEATURES).alias("__x"))
    base = sum(v * math.prod(r for *_, r in path) for v, path in leaves)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: list[dict[int, np.ndarray]] = [{} for _ in leaves]      # per leaf: pattern -> its values
        tables: dict[int, np.ndarray] = {}                             # per leaf of few conditions: the values of all patterns
        for pdf in batches:
            x = np.stack(pdf["__x"].to_numpy()) if len(pdf) else np.zeros((0, len(names)))
            columns, phi = np.ascontiguousarray(x.T), np.zeros((len(names), len(pdf)))
            for k, ((value, path), table) in enumerate(zip(leaves, known)):
                if not path:
                    continue
                short = len(path) <= few
                pattern = np.zeros(len(pdf), np.uint8 if short else np.int64)
                for i, (f, lo, hi, _) in enumerate(path):
                    on = columns[f] <= hi if lo == -math.inf else columns[f] > lo if hi == math.inf else (columns[f] > lo) & (columns[f] <= hi)
                    pattern |= on.astype(pattern.dtype) << pattern.dtype.type(i)
                if short:
                    if k not in tables:
                        on = (np.arange(1 << len(path))[:, None] >> np.arange(len(path)) & 1).astype(float)
                        tables[k] = np.ascontiguousarray((value * shares(path, on)).T)
                    place = pattern.astype(np.intp)
                    for (f, *_), of in zip(path, tables[k]):
                        phi[f] += of.take(place)
                    continue
                found, place = np.unique(pattern, return_inverse=True)
                if len(table) > 4096:       # only a memo: what is dropped is computed again
                    table.clear()
                new = np.array([p for p in found.tolist() if p not in table], np.int64)
                if len(new):
                    on = (new[:, None] >> np.arange(len(path)) & 1).astype(float)
                    table.update(zip(new.tolist(), value * shares(path, on)))
                if len(found):
                    for (f, *_), of in zip(path, np.stack([table[p] for p in found.tolist()]).T):
                        phi[f] += of.take(place)
            out = pdf[keep].copy()
            out["base"] = base
            for j, n in enumerate(names):
                out[n] = phi[j]
            yield out

    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["base double"] + [f"`{n}` double" for n in names])
    return assembled.mapInPandas(attribute, schema)


# --- rankings ----------------------------------------------------------------

def ordered_features(values: dict[str, Column]) -> Column:
    """Array of (size, index, feature, value) by falling |value|; of equals the
    later feature comes first.  Row-local: no explode, no window."""
    items = [
        F.struct(F.abs(C.as_column(v)).alias("size"), F.lit(i).alias("index"), F.lit(f).alias("feature"),
                 C.as_column(v).alias("value"))
        for i, (f, v) in enumerate(values.items())
    ]
    return F.sort_array(F.array(*items), asc=False)


def top_features(values: dict[str, Column], k: int) -> Column:
    """Names of the ``k`` largest contributions, in order."""
    return F.transform(F.slice(ordered_features(values), 1, k), lambda s: s["feature"])


def contributions(values: dict[str, Column], k: int = 3) -> Column:
    """The ``k`` largest contributions as array of structs with texts."""
    def describe(s):
        rounded = F.round(s["value"], 4)
        impact = C.impact_text(s["value"])
        return F.struct(
            s["feature"].alias("feature"), rounded.alias("shap_value"), impact.alias("impact"),
            F.format_string(fixed.IMPACT_SUMMARY, s["feature"], impact, s["value"]).alias("summary"),
        )

    return F.transform(F.slice(ordered_features(values), 1, k), describe)


def importance(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Mean absolute attribution per key and feature, long form.

    Aggregated wide (one partial row per key and task) and unpivoted after.
    """
    wide = df.groupBy(*keys).agg(*[F.avg(F.abs(F.col(f))).alias(f) for f in features])
    parts = ", ".join(f"{i}, '{f}', `{f}`" for i, f in enumerate(features))
    return wide.select(*keys, F.expr(f"stack({len(features)}, {parts}) as (feature_index, feature, importance)"))


def rank_features(long: DataFrame, keys: list[str]) -> DataFrame:
    """Add 0-based ``rank``: most important first, of equals the higher index."""
    order = W.partitionBy(*keys).orderBy(F.desc("importance"), F.desc("feature_index"))
    return long.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


# --- local surrogate ---------------------------------------------------------

def quartile_bins(df: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Per feature the edges min, q1, q2, q3, max (five numbers each)."""
    aggs = []
    for f in features:
        aggs += [
            F.percentile_approx(f, [0.25, 0.5, 0.75], 10000).alias(f"q_{f}"),
            F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"),
        ]
    row = df.agg(*aggs).first()
    return {f: [row[f"lo_{f}"], *row[f"q_{f}"], row[f"hi_{f}"]] for f in features}


def bin_of(value: Column, edges: list[float]) -> Column:
    """0 to 3 by quartile; -1, which is never drawn, for NULL.  Equal quartiles leave the bins between them empty."""
    return F.coalesce(sum(((value > F.lit(q)).cast("int") for q in edges[2:4]), (value > F.lit(edges[1])).cast("int")), F.lit(-1))


def bin_counts(df: DataFrame, features: list[str], bins: dict[str, list[float]]) -> dict[str, list[int]]:
    """Rows per quartile bin, in one aggregate; rows without a value are in none."""
    row = df.agg(*[F.coalesce(F.sum((bin_of(F.col(f), bins[f]) == k).cast("long")), F.lit(0)).alias(f"{j}_{k}")
                   for j, f in enumerate(features) for k in range(4)]).first()
    return {f: [int(row[f"{j}_{k}"]) for k in range(4)] for j, f in enumerate(features)}


def draws(spark, features: list[str], bins: dict[str, list[float]], counts: dict[str, list[int]],
          samples: int = 5000, seed: int = 42) -> DataFrame:
    """The perturbation table: ``samples - 1`` inputs that all rows share (a row's own values are its first).

    Per feature a bin is drawn as often as training rows lie in it, then a value evenly
    inside the bin, from digests of seed, number and feature.  ``__b<j>`` is the bin of feature j.
    """
    table = spark.range(1, samples).withColumnRenamed("id", "__s")
    cols = {}
    for j, f in enumerate(features):
        edges, total = bins[f], sum(counts[f])
        u, v = (C.unit_uniform(F.lit(seed), F.lit(what), F.col("__s"), F.lit(f)) for what in ("bin", "place"))
        ups = [sum(counts[f][:k + 1]) / total if total else 1.0 for k in range(3)]
        pick = sum(((u >= F.lit(c)).cast("int") for c in ups[1:]), (u >= F.lit(ups[0])).cast("int"))
        left, right = (F.element_at(F.array(*[F.lit(float(e)) for e in some]), pick + 1) for some in (edges[:4], edges[1:]))
        cols |= {f"__b{j}": pick, f: right - v * (right - left)}
    return table.withColumns(cols)


def pattern_sums(patterns: DataFrame, drawn: DataFrame, d: int) -> DataFrame:
    """Adds ``__sums`` to a table of row patterns (``__bins``, an array of d bins): the weighted sums a ridge fit needs.

    ``drawn`` has __b0.. and __p, one row per draw; it is reduced to its distinct patterns, at
    most as many as there are draws, and every row pattern is compared with those in blocks.  Near draws
    weigh more.  The sums: weights, weights times score, then per feature both for the draws in
    the row's bin, then the products of features, upper triangle.
    """
    known = drawn.groupBy(*[f"__b{j}" for j in range(d)]).agg(F.count("*").alias("n"), F.sum("__p").alias("p")).collect()
    drawn_bins = np.array([[r[f"__b{j}"] for j in range(d)] for r in known], np.int8).reshape(-1, d)
    n, p = np.array([r["n"] for r in known], float), np.array([r["p"] for r in known], float)
    upper, scale = np.triu_indices(d), -0.5 / (0.75 ** 2 * d)

    @F.pandas_udf("array<double>")
    def sums(some: pd.Series) -> pd.Series:
        out = []
        for row in some:
            same = (drawn_bins == np.asarray(row, np.int8)).astype(float)
            w = np.exp((d - same.sum(axis=1)) * scale)
            wn, wp = w * n, w * p
            out.append([wn.sum(), wp.sum(), *(wn @ same), *(wp @ same), *((same * wn[:, None]).T @ same)[upper]])
        return pd.Series(out)

    return patterns.withColumn("__sums", sums("__bins"))


def surrogate(df: DataFrame, scorer: Scorer, features: list[str], bins: dict[str, list[float]],
              row_id: str = "row_id", samples: int = 5000, seed: int = 42, top_k: int | None = None,
              alpha: float = 1.0) -> DataFrame:
    """Weights of a local linear model per row.

    The model's features say "same bin as the row"; near samples weigh more.  The draws do
    not depend on the row: they are made and scored once, whatever the number of rows, and
    their weighted sums depend on the row's bins only, so each pattern of bins is summed
    once and joined to its rows.  A row adds its own point and solves.  With ``top_k`` up to 6 features are
    chosen forward by explained variance; more by their weight in a first fit.  The scorer gets the
    features alone for the draws.  ``df`` gives the bins' frequencies.
    """
    d = len(features)
    spark = df.sparkSession
    drawn = scorer(draws(spark, features, bins, bin_counts(df, features, bins), samples, seed), "__p")
    own = F.array(*[bin_of(F.col(f), bins[f]) for f in features])
    rows = scorer(df.withColumn("__bins", own), "__p").select(row_id, "__p", "__bins")
    packed = rows.join(pattern_sums(rows.select("__bins").distinct(), drawn, d), "__bins").select(row_id, "__p", "__bins", "__sums")
    schema = ", ".join([f"`{row_id}` {dict(df.dtypes)[row_id]}", *[f"`{f}` double" for f in features]])
    return packed.mapInArrow(_solver(row_id, features, top_k or d, alpha), schema)


CHUNK = 200_000         # rows solved at once


def ridge_weights(sums: np.ndarray, place: np.ndarray, own: np.ndarray, d: int, k: int, alpha: float) -> np.ndarray:
    """One row of weights per entry of ``own`` (a row's score); ``sums`` has one row per pattern, ``place`` the pattern of a row.

    A row's matrix depends on its pattern only and its right side is linear in its score, so the subsets a forward choice tries are
    inverted once per pattern, for all its rows.
    """
    total = sums[:, 0] + 1.0
    zx = sums[:, 2:2 + d] + 1.0
    upper = np.triu_indices(d)
    a = np.zeros((len(sums), d, d))
    a[:, upper[0], upper[1]] = sums[:, 2 + 2 * d:] + 1.0
    a = a + a.transpose(0, 2, 1) - a * np.eye(d) - zx[:, :, None] * zx[:, None, :] / total[:, None, None]
    mean_y = (sums[place, 1] + own) / total[place]
    b = sums[place, 2 + d:2 + 2 * d] + own[:, None] - zx[place] * mean_y[:, None]

    def solved(used, penalty):
        """Ridge weights of the rows on the features ``used`` names per row."""
        some = a[place[:, None, None], used[:, :, None], used[:, None, :]] + penalty * np.eye(used.shape[1])
        return np.linalg.solve(some, np.take_along_axis(b, used, 1)[:, :, None])[:, :, 0]

    def forward():
        """Features by the variance they explain together; ties by position."""
        used = np.zeros((len(own), 0), int)
        for size in range(1, k + 1):
            states, at = np.unique(np.column_stack([place, used]), axis=0, return_inverse=True)
            at, gains = at.ravel(), np.full((len(own), d), -np.inf)
            for j in range(d):
                some = np.column_stack([states[:, 1:], np.full(len(states), j)])
                # the least-squares solution of least norm, also where features go together
                matrix = a[states[:, 0][:, None, None], some[:, :, None], some[:, None, :]]
                inverse = np.linalg.pinv(matrix, rcond=np.finfo(float).eps * size, hermitian=True)
                right = np.take_along_axis(b, some[at], 1)
                free = ~(used == j).any(axis=1)
                gains[free, j] = np.einsum("ni,nij,nj->n", right, inverse[at], right, optimize=False)[free]
            used = np.column_stack([used, gains.argmax(axis=1)])
        return np.sort(used, axis=1)

    used = np.tile(np.arange(d), (len(own), 1))
    if k < d:
        used = forward() if k <= 6 else np.sort(np.argsort(-np.abs(solved(used, 0.01)), axis=1, kind="stable")[:, :k], axis=1)
    weights = np.zeros((len(own), d))
    np.put_along_axis(weights, used, solved(used, alpha), 1)
    return weights


def _solver(row_id: str, features: list[str], k: int, alpha: float):
    d, weights, chunk = len(features), ridge_weights, CHUNK

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held):
            table = pa.Table.from_batches(held).combine_chunks()
            flat = lambda name, dtype: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]).astype(dtype).reshape(table.num_rows, -1)
            _, first, place = np.unique(flat("__bins", np.int8), axis=0, return_index=True, return_inverse=True)
            found = weights(flat("__sums", float)[first], place.ravel(), table["__p"].to_numpy().astype(float), d, k, alpha)
            columns = [table[row_id], *[pa.array(found[:, j]) for j in range(d)]]
            yield from pa.Table.from_arrays(columns, names=[row_id, *features]).to_batches(max_chunksize=20_000)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= chunk:
                yield from done(held)
                held = []
        if held:
            yield from done(held)
    return solve


def compare(shap_names: Column, lime_names: Column, k: int) -> dict[str, Column]:
    """Columns that compare two ordered feature lists of a row."""
    a, b = F.slice(shap_names, 1, k), F.slice(lime_names, 1, k)
    count = F.size(F.array_intersect(a, b))
    share = count / F.lit(float(k))
    return {
        "top_k": F.lit(k), "shap_top_features": F.array_join(a, ", "), "lime_top_features": F.array_join(b, ", "),
        "overlap_count": count, "overlap_ratio": share, "agreement_status": C.overlap_label(share),
    }


def compare_tables(attributions: DataFrame, surrogates: DataFrame, features: list[str], k: int = 5,
                   row_id: str = "row_id") -> DataFrame:
    """Per row: leading features by attribution and by surrogate weight."""
    left = attributions.select(row_id, top_features({f: F.col(f) for f in features}, k).alias("__a"))
    right = surrogates.select(row_id, top_features({f: F.col(f) for f in features}, k).alias("__b"))
    joined = left.join(right, row_id)
    return joined.withColumns(compare(F.col("__a"), F.col("__b"), k)).drop("__a", "__b")
