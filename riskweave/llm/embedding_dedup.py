"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, rerank.

Rotations are learned on a bounded sample (principal axes, then alternating between
binary codes and the rotation that comes closest to them).  Each table's key is a run
of bits of such a code; vectors that agree in a key are candidates and are compared
by their original values in double precision.

The bits per key follow log2 of the number of vectors, so buckets stay small as the
data grow, and the number of tables follows from the wanted chance of a miss at the
angle that a pair at the threshold has once the common mean is taken off.  A
bucket of many vectors is cut into tiles of ``tile`` vectors, and pairs of tiles are
compared as matrix products.  A tile returns a count per vector and a spanning forest
of its links, never the links; a pair that meets in several tables counts in the
first.  Equal vectors are one vector with a multiplicity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import staged
from riskweave.llm.graph import components, spanning


@dataclass
class Coder:
    """Keys of unit vectors of one dimension: a matrix per rotation, and the bits of each table."""
    mean: np.ndarray
    matrix: np.ndarray   # dimension x bits, all rotations side by side
    tables: int
    bits: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One integer per vector and table; tables differ in their leading number."""
        out, step = np.empty((len(unit), self.tables), np.int64), max(1, 2_000_000 // max(self.tables * self.bits, 1))
        for at in range(0, len(unit), step):  # the signs of a few rows at a time
            on = (unit[at:at + step] - self.mean) @ self.matrix[:, :self.tables * self.bits] > 0
            out[at:at + step] = on.reshape(len(on), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))
        return out | (np.arange(self.tables, dtype=np.int64) << self.bits)


def itq(sample: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A matrix whose signs are the code: principal axes times a learned rotation."""
    values, axes = np.linalg.eigh(sample.T @ sample / len(sample) + 1e-12 * np.eye(sample.shape[1]))
    axes = axes[:, np.argsort(values)[::-1][:bits]]
    projected = sample @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        codes = np.where(projected @ rotation > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(codes.T @ projected)
        rotation = (u @ vt).T
    return axes @ rotation


def plan(n: int, threshold: float, miss: float, spread: np.ndarray | None = None) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors: a pair at the threshold is missed with about ``miss``.

    Keys are signs of centred vectors.  ``spread`` has the squared lengths that unit
    vectors of the sample keep when the mean is taken off; the less is left, the wider
    is the angle of a pair at the threshold.  Keys get shorter then, and tables more.
    Where such a pair is no closer than any two vectors, all are compared.
    """
    left = np.maximum(np.ones(1) if spread is None else spread, 1e-12)
    same = 1 - np.arccos(np.clip(1 - (1 - threshold) / left, 0, 1)) / math.pi
    if same.mean() <= 0.5 + 1e-9:
        return 0, 1
    worth = lambda p: -math.log(p) / (math.log(2) + math.log(p))  # noqa: E731  (bucket size at which longer keys stop paying)
    wider = round(math.log2(max(1.0, worth(same.mean()) / worth(1 - math.acos(threshold) / math.pi))))
    bits = int(max(min(max(round(math.log2(max(n, 2))) - 2, 6), 30) - wider, 0))
    if not bits:
        return 0, 1
    missed = np.log1p(-np.minimum(same ** bits, 1 - 1e-12))  # of one table, per vector
    low, high = 0, 1
    while np.exp(missed * high).mean() > miss:
        low, high = high, 2 * high
    while high - low > 1:
        tables = (low + high) // 2
        low, high = (low, tables) if np.exp(missed * tables).mean() <= miss else (tables, high)
    return bits, high


def fit(sample: np.ndarray, n: int, threshold: float, miss: float, seed: int = 7) -> Coder:
    mean = sample.mean(axis=0)
    bits, tables = plan(n, threshold, miss, ((sample - mean) ** 2).sum(axis=1))
    parts, have = [], 0
    while have < max(bits * tables, 1):
        parts.append(itq(sample - mean, sample.shape[1], seed + len(parts)))
        have += parts[-1].shape[1]
    return Coder(mean, np.concatenate(parts, axis=1), tables, bits)


def unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    return x, x / np.linalg.norm(x, axis=1)[:, None]


def usable(frame: DataFrame) -> DataFrame:
    """(vec_id, dim, vector as doubles, digest) of the vectors that can be compared."""
    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    raw = (x / top if not 1e-100 < top < 1e100 else x).tobytes()
                    rows.append((vec_id, len(x), raw, xxh3_128_digest(raw)))
            yield pa.RecordBatch.from_pydict({
                "vec_id": pa.array([r[0] for r in rows], pa.int64()), "dim": pa.array([r[1] for r in rows], pa.int32()),
                "vector": pa.array([r[2] for r in rows], pa.binary()), "digest": pa.array([r[3] for r in rows], pa.binary())})

    return frame.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id long, dim int, vector binary, digest binary")


def linked(frame: DataFrame, *, threshold: float = 0.95, miss: float = 0.01, sample: int = 10_000, tile: int = 512) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Links are pairs with a cosine of at least ``threshold`` that the tables find.
    Vectors that are NULL, empty, zero or hold NULL or non-finite values link with
    nothing, nor do vectors of different lengths or rows without a vec_id (component
    NULL, kept).  Rows that repeat id and vector give one row.  ``sample`` bounds the
    vectors that rotations are learned on; all vectors are indexed.
    """
    good = staged(usable(frame).distinct(), "vectors")
    sole = staged(good.groupBy("digest", "dim").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "distinct")
    coders = {}
    for dim, n in [(int(r[0]), int(r[1])) for r in sole.groupBy("dim").count().collect()]:
        drawn = sole.where(F.col("dim") == dim).orderBy("digest").select("vector").limit(sample).collect()
        coders[dim] = fit(unit_rows([r[0] for r in drawn])[1], n, threshold, miss)

    def keyed(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                keys = coders[dim].keys(unit_rows(part.column("vector").to_pylist())[1])
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "dim": part.column("dim"), "vec_id": part.column("vec_id"), "copies": part.column("copies"), "vector": part.column("vector"),
                    "keys": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))})

    indexed = staged(sole.mapInArrow(keyed, "dim int, vec_id long, copies long, vector binary, keys array<long>"), "keys")
    entries = indexed.select("dim", F.explode("keys").alias("key"), "vec_id", "copies", "vector")
    shared = indexed.select("dim", F.explode("keys").alias("key")).groupBy("dim", "key").agg(F.count("*").alias("_n")).where("_n > 1")
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("_n") / tile))
    tiles = staged(entries.join(shared, ["dim", "key"]).groupBy("dim", "key", block.alias("block"))
                   .agg(F.collect_list(F.struct("vec_id", "copies", "vector")).alias("some")), "tiles")
    other = tiles.select("dim", "key", F.col("block").alias("block2"), F.col("some").alias("some2"))
    single = F.col("block") == F.col("block2")
    met = tiles.join(other, ["dim", "key"]).where("block <= block2").select("dim", "key", single.alias("same"), "some", F.when(~single, F.col("some2")).alias("some2"))

    def compare(batches):
        def side(some):
            x, unit = unit_rows([s["vector"] for s in some])
            return np.array([s["vec_id"] for s in some]), np.array([s["copies"] for s in some]), unit

        for batch in batches:
            counts, forest = {}, []
            for i in range(batch.num_rows):
                dim, key, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                a = side(batch.column(3)[i].as_py())
                b = a if same else side(batch.column(4)[i].as_py())
                coder = coders[dim]
                near = a[2] @ b[2].T >= threshold
                if same:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                if not len(x):
                    continue
                ka, kb = coder.keys(a[2]), coder.keys(b[2])
                first = np.empty(len(x), bool)  # is this the first table in which the pair meets?
                table = key >> coder.bits
                step = max(1, min(50_000, 2_000_000 // coder.tables))
                for at in range(0, len(x), step):
                    s = slice(at, at + step)
                    first[s] = ~(ka[x[s], :table] == kb[y[s], :table]).any(axis=1)
                x, y = x[first], y[first]
                for ids, of, n in ((a[0], x, b[1][y]), (b[0], y, a[1][x])):
                    for v, c in zip(ids.tolist(), np.bincount(of, n, len(ids)).astype(np.int64).tolist()):
                        if c:
                            counts[v] = counts.get(v, 0) + c
                forest += spanning(a[0][x].tolist(), b[0][y].tolist())
            ids = list(counts)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(ids + [p[0] for p in forest], pa.int64()), "b": pa.array([None] * len(ids) + [p[1] for p in forest], pa.int64()),
                "n": pa.array([counts[v] for v in ids] + [0] * len(forest), pa.int64())})

    found = staged(met.mapInArrow(compare, "a long, b long, n long"), "links")
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    numbers = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    described = (sole.select("digest", "vec_id", "copies").join(numbers, F.col("vec_id") == F.col("a"), "left")
                 .join(groups, F.col("vec_id") == F.col("node"), "left")
                 .select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    compared = good.select("vec_id", "digest").join(described, "digest").select("vec_id", "n_links", "component_id")
    ids = frame.select(F.col("vec_id").cast("long").alias("vec_id"))
    named = ids.where("vec_id IS NOT NULL").distinct().join(compared, "vec_id", "left")
    nameless = ids.where("vec_id IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return named.union(nameless).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
