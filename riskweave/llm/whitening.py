"""Whitening of embeddings over their distinct integer vectors.

Every vector is rounded to integers; equal ones are one row with the number of its
copies.  The fit runs on those rows, each with its copies or one as weight: exact
integer sums first, then the centred products as one matrix product per block, added
up on the executors.  A distinct vector is projected once, and the projections are
joined back to the rows by a digest of the vector.

Vectors that hold more than 1/2048 of all rows, at most 2,048 by that, have their rows
dealt out over several join keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import staged

SCALE, SHIFT, FAR = 64, 1_000_000, 2.0 ** 62
HOT = 2_048
LOW = np.int64((1 << 32) - 1)


@dataclass
class Whitener:
    """What a fit leaves: ``n`` (sum of weights), exact sums per dimension, axes as columns, their variances, the trace."""
    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the whole part of the mean is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, self.centred(x) @ self.axes / np.sqrt(self.variances), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n*x - S)^2, exact; None beyond a long.

        Arithmetic modulo 2^64 gives the right sum if that sum fits; how large it is
        is known from doubles, and near the limit from Python's integers.
        """
        near = (self.centred(x) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            gap = x.astype(np.uint64) * np.uint64(self.n % (1 << 64)) - np.array([s % (1 << 64) for s in self.sums], np.uint64)
            total = (gap * gap).sum(axis=1, dtype=np.uint64)
        out: list[int | None] = []
        for row, guess, value in zip(x, near.tolist(), total.tolist()):
            if guess > 9e18:
                value = sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums))
            out.append(value if value < 1 << 63 else None)
        return out


def integers(vectors: DataFrame, vector: str, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row: ``row`` (its vec_id), ``dims`` and ``x``, floor(scale * c) + shift per entry as little-endian int64.

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are dropped.
    Entries beyond +-2^62 before the shift stay there.
    """
    schema = pa.schema([("row", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                ids, lists = part.column(0), part.column(1)
                flat = lists.flatten()                       # NULL lists have no entries here
                sizes = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
                bad = ~np.isfinite(np.asarray(flat.to_numpy(zero_copy_only=False), np.float64))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                usable = (sizes > 0) & (np.bincount(owner, bad, minlength=len(sizes)) == 0)
                values = np.where(bad, 0.0, np.asarray(flat.to_numpy(zero_copy_only=False), np.float64))
                with np.errstate(over="ignore"):
                    raw = (np.floor(np.clip(values * scale, -FAR, FAR)).astype(np.int64) + shift).astype("<i8").tobytes()
                ends = np.cumsum(sizes)
                keep = np.flatnonzero(usable).tolist()
                yield pa.RecordBatch.from_arrays([
                    ids.filter(pa.array(usable)), pa.array(sizes[usable].astype(np.int32)),
                    pa.array([raw[8 * (ends[i] - sizes[i]):8 * ends[i]] for i in keep], pa.binary())], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("row"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "row long, dims int, x binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def _by_dims(batch: pa.RecordBatch):
    """(dims, part of the batch) for each vector length in it."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def added_up(partial: DataFrame) -> DataFrame:
    """(dims, i, values): the sum of the float64 arrays of equal (dims, i), added where the parts meet."""
    def add(part: pa.Table) -> pa.Table:
        total = None
        for value in part.column("values").to_pylist():
            value = np.frombuffer(value, "<f8")
            total = value if total is None else total + value
        return pa.table({"dims": part.column("dims").slice(0, 1), "i": part.column("i").slice(0, 1), "values": pa.array([total.tobytes()], pa.binary())})

    return partial.groupBy("dims", "i").applyInArrow(add, "dims int, i int, values binary")


def sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dims -> (sum of the weights, exact weighted sums per dimension).  One row per dimension reaches the driver."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, part in _by_dims(batch):
                x, w = _matrix(part.column("x"), d), part.column("weight").to_numpy().astype(np.int64)
                one = held.setdefault(d, [0, [0] * d])
                # halves of 32 bits times weights, in Python's integers where they could leave 63 bits
                high, low = x >> np.int64(32), x & LOW
                exact = w.sum() < 1 << 30
                fold = (lambda m: (m * w[:, None]).sum(axis=0).tolist()) if exact else (lambda m: [sum(int(a) * int(b) for a, b in zip(c, w)) for c in m.T])
                one[0] += int(w.sum())
                one[1] = [s + (h << 32) + l for s, h, l in zip(one[1], fold(high), fold(low))]
        for d, (n, total) in held.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                                              "n": pa.array([n] * d, pa.int64()), "s": pa.array([str(s) for s in total], pa.string())})

    rows = (distinct.select("dims", "x", "weight").mapInArrow(run, "dims int, i int, n long, s string")
            .groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dims", "i").collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["dims"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def fit(distinct: DataFrame, components: int) -> dict[int, Whitener]:
    """dims -> Whitener over a table of (dims, x, weight), one row per distinct vector.

    Two passes: sums, then centred products.  A task sends one matrix row per dimension
    to where they are added; the driver gets one dims x dims matrix.  Axes are unit
    eigenvectors by falling eigenvalue, their largest entry positive.  Eigenvalues that
    rounding cannot tell from zero become zero.
    """
    totals = sums(distinct)
    centre = {d: Whitener(n, s, np.empty((d, 0)), np.empty(0), 0.0) for d, (n, s) in totals.items()}

    def products(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in _by_dims(batch):
                y, w = centre[d].centred(_matrix(part.column("x"), d)), part.column("weight").to_numpy()
                held[d] = held.get(d, 0.0) + (y * w[:, None]).T @ y
        for d, m in held.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                                              "values": pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())})

    rows = added_up(distinct.select("dims", "x", "weight").mapInArrow(products, "dims int, i int, values binary")).collect() if totals else []
    out = {}
    for d, (n, s) in totals.items():
        cov = np.zeros((d, d))
        for r in rows:
            if r["dims"] == d:
                cov[r["i"]] = np.frombuffer(bytes(r["values"]), "<f8") / n
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        trace = float(np.trace(cov))
        out[d] = Whitener(n, s, axes, np.where(values > d * np.finfo(float).eps * max(trace, 0.0), values, 0.0), trace)
    return out


def identity_errors(projected: DataFrame, fitted: dict[int, Whitener]) -> dict[int, float | None]:
    """dims -> largest absolute entry of the whitened rows' weighted covariance minus the identity.

    ``projected`` has dims, weight and whitened (float64 bytes).  Means first, then
    centred products.  Components without variance are left out; None if there is no other.
    """
    live = {d: np.flatnonzero(w.variances > 0) for d, w in fitted.items()}

    def parts(mean):
        def run(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for d, part in _by_dims(batch):
                    z = np.frombuffer(b"".join(part.column("whitened").to_pylist()), "<f8").reshape(part.num_rows, -1)[:, live[d]]
                    w = part.column("weight").to_numpy()[:, None]
                    z = z - mean[d] if mean else z
                    held[d] = held.get(d, 0.0) + ((z * w).T @ z if mean else (z * w).sum(axis=0))
            for d, m in held.items():
                if m.size:
                    yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "i": pa.array([0], pa.int32()), "values": pa.array([m.tobytes()], pa.binary())})
        rows = added_up(projected.select("dims", "weight", "whitened").mapInArrow(run, "dims int, i int, values binary")).collect()
        return {r["dims"]: np.frombuffer(bytes(r["values"]), "<f8") / fitted[r["dims"]].n for r in rows}

    mean = parts(None)
    found = parts(mean) if mean else {}
    return {d: float(np.abs(found[d].reshape(len(live[d]), -1) - np.eye(len(live[d]))).max()) if d in found else None for d in fitted}


def whiten(vectors: DataFrame, *, vector: str = "embedding", components: int = 16, weights: str = "one",
           scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``weights``: "one" fits on each distinct vector once, "counts" on each as often as it
    occurs.  Defined results: rows with NULL, empty or non-finite vectors are dropped;
    repeated rows and NULL ids are whitened each; vectors of several lengths are fitted
    by length; a component without variance has whitened NULL (explained too if nothing
    varies); deviation beyond a long is NULL; an empty table gives no rows.  Other
    columns than vec_id and the vector are not read.
    """
    if weights not in ("one", "counts"):
        raise ValueError("weights: one or counts")
    rows = integers(vectors, vector, scale, shift)
    distinct = staged(rows.groupBy("dims", "x").agg(F.count("*").alias("copies"))
                      .withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long")), "distinct")
    fitted = fit(distinct, components)
    schema = pa.schema([("key", pa.string()), ("dims", pa.int32()), ("weight", pa.int64()), ("copies", pa.int64()),
                        ("deviation", pa.int64()), ("whitened", pa.binary())])

    def project(batches):
        for batch in batches:
            for d, part in _by_dims(batch):
                x = _matrix(part.column("x"), d)
                z = fitted[d].whitened(x)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("dims"), part.column("weight"), part.column("copies"),
                                                  pa.array(fitted[d].deviations(x), pa.int64()), pa.array([r.tobytes() for r in z], pa.binary())], schema=schema)

    key = F.md5("x").alias("key")
    projected = staged(distinct.select(key, "dims", "x", "weight", "copies").mapInArrow(
        project, "key string, dims int, weight long, copies long, deviation long, whitened binary"), "whitened")
    errors = identity_errors(projected, fitted)
    total = projected.agg(F.sum("copies")).first()[0] or 0

    # a vector with more than 1/HOT of all rows: its rows are dealt out over several keys
    parts = F.floor(F.col("copies") * F.lit(HOT) / F.lit(max(total, 1))).cast("long")
    hot = projected.where(F.col("copies") * F.lit(HOT) > F.lit(total)).select("key", (parts + 1).alias("parts"))
    slot = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), "parts"))
    keyed = rows.select("row", key).join(F.broadcast(hot), "key", "left").select("row", "key", slot.cast("long").alias("slot"))
    copies = F.when(F.col("copies") * F.lit(HOT) > F.lit(total), parts).otherwise(0)
    spread = projected.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long"))))

    shares = {d: [float(e / w.trace) if w.trace > 0 else None for e in w.variances.tolist()] for d, w in fitted.items()}
    out = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def unfold(batches):
        for batch in batches:
            for d, part in _by_dims(batch):
                z = np.frombuffer(b"".join(part.column("whitened").to_pylist()), "<f8").reshape(part.num_rows, -1)
                k, m = z.shape[1], part.num_rows
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("row").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([fitted[d].n] * (m * k), pa.int64()),
                    part.column("deviation").take(pa.array(each)), pa.array(z.reshape(-1), pa.float64(), mask=np.isnan(z.reshape(-1))),
                    pa.array(shares[d] * m, pa.float64()), pa.array([errors[d]] * (m * k), pa.float64())], schema=out)

    return (keyed.join(spread, ["key", "slot"]).select("row", "dims", "deviation", "whitened")
            .mapInArrow(unfold, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"))
