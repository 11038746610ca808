"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds sum(c_i * B^i) mod p for every prefix, at two bases of
the field of p = 2^31 - 1.  A difference of two entries, divided by a power of B, is the
hash of that span wherever it lies, so any two spans are compared in constant time and
the longest common extension of two places is found by binary search.

A fingerprint keeps at most a few hundred bytes of it: the length, the hash of the whole
text, hashes of prefixes and suffixes at multiples of a step (a power of two, so texts of
different length share rungs), and the smallest hashes of all spans of 32 characters.
Two fingerprints give the share of text they have in common, from the longest common
prefix and suffix (binary search over the rungs) or from the sample of spans, whichever
finds more.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import staged

P = np.uint64((1 << 31) - 1)
BASES = (1_103_515_245, 1_566_083_941)
BLOCK = 1 << 18       # characters whose powers are in a table; longer texts carry on block by block
RUNGS, SAMPLE, SPAN = 32, 32, 32
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def partly(x: np.ndarray) -> np.ndarray:
    """A number below 2^32 that is x mod 2^31 - 1, of numbers below 2^62."""
    return (x & P) + (x >> np.uint64(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1, of numbers below 2^62."""
    x = partly(partly(x))
    return np.minimum(x, x - P)         # below zero wraps around to a large number


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Per base: its powers 0..BLOCK and those of its inverse, by doubling."""
    if not _POWERS:
        for base in BASES:
            both = []
            for b in (base, pow(base, -1, int(P))):
                table = np.ones(1, np.uint64)
                while len(table) <= BLOCK:
                    table = np.concatenate([table, reduced(table * np.uint64(pow(b, len(table), int(P))))])
                both.append(table[:BLOCK + 1])
            _POWERS.append((both[0], both[1]))
    return _POWERS


def code_points(text: str) -> np.ndarray:
    """Code points plus one, so that no character is zero."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)


class Prefixes:
    """The modular prefix arrays of a text: span hashes, equality of spans, longest common extensions."""

    def __init__(self, text: str, start: Prefixes | None = None, kept: int = 0):
        """``start`` and ``kept``: the first ``kept`` characters are those of that text, whose arrays are gone on from."""
        self.n = len(text)
        self.sums = []
        codes = code_points(text[kept:])
        for k, (power, _) in enumerate(powers()):
            out = np.zeros(self.n + 1, np.uint32)
            if kept:
                out[:kept + 1] = start.sums[k][:kept + 1]
            for at in range(0, len(codes), BLOCK):
                some = codes[at:at + BLOCK].astype(np.uint64)
                local = np.cumsum(partly(some * power[:len(some)]), dtype=np.uint64)       # below 2^50
                if at + kept:
                    local = reduced(local) * np.uint64(pow(int(power[1]), at + kept, int(P))) + np.uint64(int(out[at + kept]))
                out[at + kept + 1:at + kept + 1 + len(some)] = reduced(local)
            self.sums.append(out)
        known = start.windows[:max(0, kept - SPAN + 1)] if kept else np.empty(0, "<u4")
        self.windows = np.concatenate([known, *self._windows(len(known))])

    def _windows(self, at: int):
        """Hashes of all spans of SPAN characters from the one at ``at`` on; a shorter text is one span."""
        end = max(1, self.n - SPAN + 1) if self.n else 0
        for first in range(at, end, BLOCK):
            start = np.arange(first, min(first + BLOCK, end))
            yield folded(self.spans(start, np.minimum(start + SPAN, self.n)))

    def spans(self, start, stop) -> np.ndarray:
        """62-bit hashes of text[start:stop], whatever its place; arrays or single numbers."""
        start, stop = np.atleast_1d(np.asarray(start, np.int64)), np.atleast_1d(np.asarray(stop, np.int64))
        keys = []
        for (_, inverse), sums in zip(powers(), self.sums):
            gap = reduced(sums[stop].astype(np.uint64) + P - sums[start].astype(np.uint64))
            if self.n <= BLOCK:
                keys.append(reduced(gap * inverse[start]))
            else:
                far, step = start // BLOCK, int(inverse[BLOCK])
                blocks = np.array([pow(step, k, int(P)) for k in range(int(far.max()) + 1 if len(far) else 1)], np.uint64)
                keys.append(reduced(reduced(gap * inverse[start % BLOCK]) * blocks[far]))
        return (keys[0] << np.uint64(31)) | keys[1]

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Is text[start:start + length] the same as the other's at its place?  Constant time."""
        return all((int(x[start + length]) - int(x[start])) * pow(base, at, int(P)) % int(P)
                   == (int(y[at + length]) - int(y[at])) * pow(base, start, int(P)) % int(P)
                   for base, x, y in zip(BASES, self.sums, other.sums))

    def extension(self, start: int, other: Prefixes, at: int, *, back: bool = False) -> int:
        """How far both texts agree from these places on (or before them, with ``back``), by binary search."""
        low, high = 0, min(start, at) if back else min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            same = self.equal(start - middle, other, at - middle, middle) if back else self.equal(start, other, at, middle)
            low, high = (middle, high) if same else (low, middle - 1)
        return low


# --- fingerprints ------------------------------------------------------------------

def step_of(n: int) -> int:
    """The smallest power of two that gives fewer than RUNGS rungs."""
    return 1 << max(0, (n // RUNGS).bit_length())


def folded(keys: np.ndarray) -> np.ndarray:
    """32 bits of a span hash."""
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    some = 8 * k
    while some < len(values):
        found = np.unique(np.partition(values, some)[:some])
        if len(found) >= k:
            return found[:k]
        some *= 8
    return np.unique(values)[:k]


def fingerprint(text: str, made: Prefixes | None = None) -> str:
    """Length, whole hash, rungs from the front and from the back, sample of spans; base64."""
    p = made or Prefixes(text)
    n, step = p.n, step_of(p.n)
    rungs = np.arange(step, n + 1, step)
    keys = p.spans(np.concatenate([np.zeros(len(rungs) + 1, np.int64), n - rungs]), np.concatenate([[n], rungs, np.full(len(rungs), n)]))
    return base64.b64encode(struct.pack("<QQ", n, int(keys[0])) + folded(keys[1:]).tobytes() + smallest(p.windows, SAMPLE).tobytes()).decode()


def opened(fp: str) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    raw = base64.b64decode(fp)
    n, whole = struct.unpack_from("<QQ", raw)
    k = n // step_of(n)
    numbers = np.frombuffer(raw, "<u4", offset=16)
    return n, whole, numbers[:k], numbers[k:2 * k], numbers[2 * k:]


def shared_rungs(x: np.ndarray, y: np.ndarray, step_x: int, step_y: int) -> int:
    """Characters up to the last common rung, by binary search: an agreeing prefix agrees at all rungs before."""
    step = max(step_x, step_y)
    x, y = x[step // step_x - 1::step // step_x], y[step // step_y - 1::step // step_y]
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[middle - 1] == y[middle - 1] else (low, middle - 1)
    return low * step


def likeness(a: str, b: str) -> float:
    """Share of text in common, 0 to 1; 1 for equal texts, two empty ones too."""
    (n, whole, front, back, spans), (m, other, front2, back2, spans2) = opened(a), opened(b)
    if n == m and whole == other:
        return 1.0
    if not n or not m:
        return 0.0
    ends = shared_rungs(front, front2, step_of(n), step_of(m)) + shared_rungs(back, back2, step_of(n), step_of(m))
    by_ends = 2 * min(ends, n, m) / (n + m)
    x, y = set(spans.tolist()), set(spans2.tolist())
    union = sorted(x | y)[:SAMPLE]
    jaccard = sum(v in x and v in y for v in union) / len(union)
    return float(min(max(by_ends, 2 * jaccard / (1 + jaccard)), 1 - 1 / (n + m)))


# --- on tables -----------------------------------------------------------------------

def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text, in one pass without a shuffle.  NULL counts as empty."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])],
                                             ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def extensions(pairs: DataFrame) -> DataFrame:
    """Adds ``forward`` and ``backward`` to a table of text_a, at_a, text_b, at_b: how far the texts agree
    from the places on, and before them.  NULL texts are empty; places outside a text, or NULL, give NULL."""
    def run(batches):
        for batch in batches:
            out = []
            for a, i, b, j in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a, b = a or "", b or ""
                if i is None or j is None or not (0 <= i <= len(a) and 0 <= j <= len(b)):
                    out.append((None, None))
                    continue
                p, q = Prefixes(a), Prefixes(b)
                out.append((p.extension(i, q, j), p.extension(i, q, j, back=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())],
                                             ["text_a", "at_a", "text_b", "at_b", "forward", "backward"])

    return (pairs.select(F.col("text_a").cast("string"), F.col("at_a").cast("long"), F.col("text_b").cast("string"), F.col("at_b").cast("long"))
            .mapInArrow(run, "text_a string, at_a long, text_b string, at_b long, forward long, backward long"))


def ranges(docs: DataFrame, bucket_rows: int, most: int = 16_384) -> tuple[DataFrame, int]:
    """Adds ``bucket``, a number that rises along descending doc_id (NULLs last, ties by ``h``); and how many there are.

    The cuts are approximate quantiles of the ids and only balance the work.  An id
    that fills several cuts, or NULL, is dealt out further by ranges of ``h``.
    """
    from pyspark.ml.feature import Bucketizer

    number = F.col("doc_id").cast("double").alias("v")
    total, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    buckets = min(most, max(1, -(-total // bucket_rows)))
    cuts = docs.select(number).approxQuantile("v", [k / buckets for k in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    times = {v: cuts.count(v) for v in set(cuts)} if len(set(cuts)) < len(cuts) else dict.fromkeys(cuts, 1)
    hot = {v: k for v, k in times.items() if k > 1}
    points = sorted({*times, *(float(np.nextafter(v, np.inf)) for v in hot)})
    if points:
        cut = Bucketizer(splits=[-np.inf, *points, np.inf], inputCol="v", outputCol="place")
        docs = cut.transform(docs.withColumn("v", number)).withColumn("place", len(points) - F.col("place").cast("long"))
    else:
        docs = docs.withColumn("v", number).withColumn("place", F.lit(0).cast("long"))
    nameless = (total - named) * buckets // max(total, 1)
    parts = F.when(F.col("doc_id").isNull(), nameless + 1)
    for v, k in hot.items():
        parts = parts.when(F.col("v") == v, k + 1)
    parts = parts.otherwise(1)
    fine = F.least(F.floor((F.col("h").cast("double") / 2.0 ** 64 + 0.5) * parts), parts - 1)
    main = F.when(F.col("doc_id").isNull(), len(points) + 1).otherwise(F.col("place"))
    return docs.withColumn("bucket", main.cast("long") * (1 << 20) + fine.cast("long")).drop("v", "place"), len(points) + 2 + nameless + sum(hot.values())


def edits(docs: DataFrame, *, bucket_rows: int = 1_000) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_chars, common_next.

    The edited text has its last third (rounded down) replaced by as many first
    characters of the next document, or all it has; next is by descending doc_id, and
    the first after the last.  ``near_*`` are :func:`likeness` of the fingerprints, ``common_*`` the
    exact lengths of the common prefix with the edited and the next text, by binary search.

    NULL and empty texts count as empty; NULL ids come last; repeated ids follow each
    other by the hash of their texts (equal rows are next to each other); a single
    document follows itself.  Other columns than doc_id and text are not read.

    Documents are dealt out by ranges of doc_id, texts once; each range also gets a copy
    of the first row of the next one.  A task walks its range and holds two documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows, n = ranges(rows, bucket_rows)
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("order"), "h")
    heads = staged(rows.groupBy("bucket").agg(F.min(first).alias("k"), F.count("*").alias("rows")), "heads")
    order = [r["bucket"] for r in heads.select("bucket").orderBy("bucket").collect()]       # one number per range
    before = {b: order[k - 1] for k, b in enumerate(order)}                                 # the range that ends with b's first row
    link = heads.sparkSession.createDataFrame(list(before.items()), "bucket long, target long") if before else None
    if link is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    joined = heads.join(F.broadcast(link), "bucket").select("bucket", "target", F.bitwise_not("k.order").alias("id"), F.col("k.h").alias("head_h"))
    extra = (rows.join(F.broadcast(joined), "bucket").where(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("head_h")))
             .groupBy("target").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("h").alias("h"))
             .select("doc_id", "text", "h", F.col("target").alias("bucket"), F.lit(1).alias("extra")))
    dealt = (rows.select("doc_id", "text", "h", "bucket", F.lit(0).alias("extra")).unionByName(extra)
             .repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "h"))
    return dealt.select("doc_id", "text", "bucket", "extra").mapInArrow(_walk, _OUT)


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "common_chars long, common_next long")


def _walk(batches):
    """Rows in order; each is finished when the next one is there.  A range ends with its extra row."""
    import hashlib

    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    held = None
    for batch in batches:
        out = []
        for doc_id, text, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            text = text or ""
            made = Prefixes(text)
            now = (doc_id, text, made, fingerprint(text, made))
            if held is not None:
                old_id, old, old_made, old_print = held
                k = len(old) // 3
                edited = old[:len(old) - k] + text[:k]
                edited_made = Prefixes(edited, old_made, len(old) - k) if k else old_made
                edited_print = fingerprint(edited, edited_made) if k else old_print
                out.append((old_id, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), old_print, edited_print,
                            likeness(old_print, edited_print), likeness(old_print, now[3]),
                            old_made.extension(0, edited_made, 0), old_made.extension(0, made, 0)))
            held = None if extra else now
        columns = zip(*out) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
