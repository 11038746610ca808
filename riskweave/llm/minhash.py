"""Near-duplicates by SuperMinHash signatures, banding, exact verification, union-find.

SuperMinHash gives each element one value per step and a permuted slot to put it in;
the values of step j are j plus a fraction, so once every slot holds less than j no
later step can change anything.  A text with many shingles needs two or three steps
where ordinary MinHash needs as many as the signature is long.

Texts with the same shingle set count as one from the start, however many copies.
Documents that agree in a band are candidates.  In each bucket all members are
compared with the smallest one.  Buckets that still hold several components are
settled by an exact join of their members' sets on their rarest shingles: two sets that are
alike enough must share one of them, how many is known from both sizes, and only pairs
of different components are formed.  So every candidate pair is confirmed on the full
sets or lies in one component already; neither the pairs of a large group of copies nor
those of many pages on one template are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.llm.common import fresh, staged
from riskweave.llm.graph import components, merged

BLOCK = 1 << 20   # bytes of text hashed at a time
ONE = np.uint64(1)
SLOTS = 1 << 20     # of the sketch that tells rare shingles from common ones
STARS = 3           # rounds of stars before the join on rare shingles; they save pairs, the join settles the rest whatever their number
_TABLES: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tables() -> dict[str, np.ndarray]:
    """A random number per byte (capitals A-Z as small letters), and powers of an odd base and of its inverse."""
    if not _TABLES:
        base = 0x9E3779B97F4A7C15
        letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        letters[65:91] = letters[97:123]
        power = lambda b: np.multiply.accumulate(np.concatenate([[ONE], np.full(BLOCK + 1, b, np.uint64)]))
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _TABLES.update(letters=letters, power=power(np.uint64(base)), inverse=power(np.uint64(pow(base, -1, 1 << 64))), space=space)
    return _TABLES


def word_sums(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, polynomial sum) of the words of at most BLOCK bytes, by differences of prefix sums: no loop over words."""
    t = tables()
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~t["space"][raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(t["letters"][raw] * t["power"][:len(raw)], dtype=np.uint64)])
        return start, (end - start).astype(np.uint64), (sums[end] - sums[start]) * t["inverse"][start]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of at most BLOCK bytes."""
    start, length, total = word_sums(data)
    with np.errstate(over="ignore"):
        return start, mixed(total + length)


def long_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, block by block; a word that goes on in the next block is carried over."""
    base, wrap, out = int(tables()["power"][1]), (1 << 64) - 1, []
    held: tuple[int, int] | None = None         # length and sum of a word that ends with its block
    for at in range(0, len(data), BLOCK):
        block = data[at:at + BLOCK]
        start, length, total = word_sums(block)
        if held and len(start) and start[0] == 0:
            n, s = held
            total[0] = np.uint64((s + pow(base, n, 1 << 64) * int(total[0])) & wrap)
            length[0] += np.uint64(n)
            held = None
        elif held:
            start, length, total = np.insert(start, 0, 0), np.insert(length, 0, np.uint64(held[0])), np.insert(total, 0, np.uint64(held[1]))
            held = None
        if len(start) and not tables()["space"][block[-1]]:
            held = int(length[-1]), int(total[-1])
            length, total = length[:-1], total[:-1]
        with np.errstate(over="ignore"):
            out.append(mixed(total + length))
    if held:
        out.append(mixed(np.array([(held[0] + held[1]) & wrap], np.uint64)))
    return np.concatenate(out)


def sets_of(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted.  Texts are hashed together as far as they fit a block."""
    out: list = [None] * len(texts)
    held, names, length = [], [], 0

    def flush():
        nonlocal held, names, length
        if held:
            at = np.cumsum([0] + [len(x) + 1 for x in held])
            start, hashes = word_hashes(b"\n".join(held))
            for name, words in zip(names, np.split(hashes, np.searchsorted(start, at[1:-1]))):
                out[name] = shingles(words, size)
        held, names, length = [], [], 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) + 1 > BLOCK:
            out[i] = shingles(long_hashes(data), size)
            continue
        if length + len(data) + 1 > BLOCK:
            flush()
        held.append(data)
        names.append(i)
        length += len(data) + 1
    flush()
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` words in a row; of the whole sequence if it is shorter; none without words."""
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k])
    return np.unique(total)


def super_minhash(sets: list[np.ndarray], slots: int, chunk: int = 100_000) -> np.ndarray:
    """One row of ``slots`` values per set; a value is (step << 32) + fraction.  Empty sets keep the maximum."""
    signature = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = signature.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    width = np.uint8 if slots <= 256 else np.uint16
    for at in range(0, len(values), chunk):
        x, d = values[at:at + chunk], owner[at:at + chunk]
        order = np.tile(np.arange(slots, dtype=width), (len(x), 1))
        row = np.arange(len(x))
        for step in range(slots):
            with np.errstate(over="ignore"):
                r = mixed(x + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15))
            pick = step + ((r >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[row, step]
            np.minimum.at(flat, d * slots + slot, (np.uint64(step) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF)))
            some = np.unique(d)
            open_ = np.zeros(len(sets), bool)
            open_[some] = signature[some].max(axis=1) >= np.uint64(step + 1) << np.uint64(32)
            keep = open_[d]
            if not keep.any():
                break
            if keep.sum() < 0.7 * len(keep):
                x, d, order = x[keep], d[keep], order[keep]
                row = np.arange(len(x))
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band; bands differ in their seed, so keys of different bands do not meet."""
    keys = []
    with np.errstate(over="ignore"):
        for b in range(signature.shape[1] // rows):
            key = np.full(len(signature), b + 1, np.uint64)
            for c in range(b * rows, (b + 1) * rows):
                key = mixed(key * np.uint64(0xD1342543DE82EF95) + signature[:, c])
            keys.append(key)
    return np.stack(keys, axis=1).astype(np.int64, casting="unsafe") if keys else np.empty((len(signature), 0), np.int64)


# --- on tables -------------------------------------------------------------------

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sliced(batches, step: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column(0), part.column(1).to_pylist()


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n_shingles, digest of the set, keys (one per band; none for an empty set)."""
    def run(batches):
        from xxhash import xxh3_128_digest

        for ids, texts in _sliced(batches):
            sets = sets_of(texts, size)
            keys = band_keys(super_minhash(sets, bands * rows), rows)
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                "keys": pa.array([k if len(s) else [] for k, s in zip(keys.tolist(), sets)], pa.list_(pa.int64()))})

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, the digest of its set, and the sorted hashes of its shingles."""
    def run(batches):
        from xxhash import xxh3_128_digest

        for ids, texts in _sliced(batches):
            sets = sets_of(texts, size)
            values = np.concatenate(sets).astype(np.int64, casting="unsafe")
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "digest", "hashes"])

    return _texts(docs).mapInArrow(run, "doc_id long, digest binary, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet in at least ``percent`` % of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b"))


def size_bins(n: np.ndarray | int) -> np.ndarray:
    """Set sizes in classes: each of its own up to 64, then steps of 2 %."""
    n = np.asarray(n, np.float64)
    return np.where(n <= 64, n, 64 + np.ceil(np.log(np.maximum(n, 64) / 64) / np.log(1.02) - 1e-9)).astype(np.int64)


def smallest_of(size_bin: np.ndarray) -> np.ndarray:
    """A lower bound of the sizes in a class."""
    return np.where(size_bin <= 64, size_bin, np.floor(64 * 1.02 ** (size_bin - 65.0))).astype(np.int64)


def rare_keys(hashes: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set meets every set that is alike enough, one per class of partner's sizes and rare shingle; and
    the side it takes there: 0 if the partner's class is larger, 1 if it is smaller, 2 if it is the same.

    Sets of n and m shingles with a similarity of at least p share at least
    a = p (n + m) / (1 + p) of them; then the n - a + 1 first of one and the m - a + 1 first of the other,
    in whatever order all sets agree on, share one.  The order here is by ``ranks``, rarest first.
    """
    n = len(hashes)
    own = int(size_bins(n))
    ordered = hashes[np.lexsort((hashes, ranks))]
    low, high = max(1, -(-n * percent // 100)), n * 100 // percent
    partners = np.arange(int(size_bins(low)), int(size_bins(high)) + 1)
    least = np.maximum(smallest_of(partners), low)
    shared = -(-percent * (n + least) // (100 + percent))
    count = np.clip(n - shared + 1, 0, n)
    each, place = np.repeat(partners, count), np.concatenate([np.arange(c) for c in count]) if count.sum() else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        pair = mixed((np.minimum(own, each).astype(np.uint64) << np.uint64(32)) | np.maximum(own, each).astype(np.uint64))
        return mixed(ordered[place] + pair).astype(np.int64, casting="unsafe"), np.where(each > own, 0, np.where(each < own, 1, 2)).astype(np.int32)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy().view(np.uint64), column.offsets.to_pylist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def rarity(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle, per slot of a sketch of fixed size.  It orders shingles only; any order gives the same result."""
    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            seen += np.bincount((batch.column(0).values.to_numpy().view(np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(seen)
        for at in range(0, len(slots), 100_000):
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slots[at:at + 100_000], pa.int64()), "n": pa.array(seen[slots[at:at + 100_000]], pa.int64())})

    found = sets.select("hashes").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()     # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def across(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that can be alike enough; ``sets`` has node, component, hashes.

    Under each key the members outside its largest component meet those of the other side.
    """
    counts = rarity(sets)

    def run(batches):
        for batch in batches:
            for node, component, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2))):
                keys, side = rare_keys(hashes, counts[(hashes % np.uint64(SLOTS)).astype(np.int64)], percent)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "side": pa.array(side), "node": pa.array([node] * len(keys), pa.int64()),
                                                  "component": pa.array([component] * len(keys), pa.int64()), "n": pa.array([len(hashes)] * len(keys), pa.int64())})

    keyed = sets.select("node", "component", "hashes").mapInArrow(run, "key long, side int, node long, component long, n long")
    per = keyed.groupBy("key", "component").agg(F.count("*").alias("members"))
    mixed_keys = per.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("members", "component")).alias("m")).where("components > 1").select("key", F.col("m.component").alias("largest"))
    rest = staged(keyed.join(mixed_keys, "key"), "rare")
    small = rest.where("component <> largest").select(
        "key", F.when(F.col("side") < 2, 1 - F.col("side")).otherwise(2).alias("side"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    return (small.join(rest.drop("largest"), ["key", "side"]).where((F.col("cx") != F.col("component")) & (100 * F.least("nx", "n") >= percent * F.greatest("nx", "n")))
            .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct())


def _classes(docs: DataFrame, size: int, percent: int, bands: int, rows: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n_shingles, digest; sets: digest, doc_id, component, at), doc_id the smallest with that set.

    Sets are nodes with a number of their own; a component (``at``) is called by the
    smallest doc_id in it, which two components share if that id occurs with several sets.
    ``by_id`` also links the sets of a doc_id that occurs with several.
    """
    made = staged(signatures(docs, size, bands, rows), "signatures")
    known = made.where("doc_id IS NOT NULL")
    # copies of one set: the smallest id stands for them
    groups = known.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("m"))
    sets_known = staged(groups.select(F.monotonically_increasing_id().alias("node"), "digest", "m.*"), "sets")
    keyed = sets_known.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("n"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("first")).where("members > 1")
    buckets = staged(keyed.join(shared, "key").select("key", "members", "node", "n", F.col("first.node").alias("first"), F.col("first.n").alias("first_n")), "buckets")

    def alike(x: Column | str, y: Column | str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    pairs = staged(buckets.where((F.col("node") != F.col("first")) & alike("n", "first_n")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    near = buckets.select("node").distinct().join(sets_known.select("node", "doc_id", "digest"), "node")
    # the texts of these sets, read again: by id, and by digest where an id has several
    texts = _texts(docs).join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = staged(shingle_sets(texts, size).join(near, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "hashes"), "shingles")
    links = staged(confirmed(pairs, sets, percent), "links")
    found = staged(components(links), "found")

    def opened(members: DataFrame, found: DataFrame) -> DataFrame:
        """Those of ``members`` (key, node, n) whose bucket holds several components; what is in one component stays so."""
        labelled = members.select("key", "node", "n").join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return staged(labelled.join(split, "key", "left_semi"), "open")

    # stars again, around a member of each open bucket's largest component: they merge most of what is left, with one pair a member
    still = opened(buckets.where("members > 2"), found)
    for turn in range(STARS):
        parts = still.groupBy("key", "component").agg(F.count("*").alias("members"), F.max(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n")).alias("pivot"))
        pivots = parts.groupBy("key").agg(F.max(F.struct("members", "component", "pivot")).alias("m")).select(
            "key", F.col("m.component").alias("largest"), F.col("m.pivot.node").alias("pivot"), F.col("m.pivot.n").alias("pivot_n"))
        star = (still.join(pivots, "key").where((F.col("component") != F.col("largest")) & alike("n", "pivot_n"))
                .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct())
        new = staged(confirmed(staged(star, "pairs"), sets, percent), "links")
        if new.isEmpty():       # the join below settles what is left
            break
        found = merged(found, new)
        still = opened(still, found)
    if not still.isEmpty():
        open_ = staged(still.select("node", "component").distinct().join(sets, "node"), "open")
        found = merged(found, staged(confirmed(staged(across(open_, percent), "pairs"), sets, percent), "links"))
    if by_id:
        several = known.where("n_shingles > 0").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
        of_id = known.join(several, "doc_id", "left_semi").join(sets_known.select("digest", "node"), "digest").select("doc_id", "node")
        same = of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
        found = merged(found, staged(same, "links"))
    named = sets_known.select("node", "digest", "doc_id").join(found, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("at"))
    names = named.groupBy("at").agg(F.min("doc_id").alias("component"))
    return made.select("doc_id", "n_shingles", "digest"), named.join(names, "at").select("digest", "doc_id", "component", "at")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 26, rows: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer than ``size`` words is one shingle, a text without words (or NULL) is
    linked with nothing.  Links are pairs with a Jaccard similarity of at least
    ``percent`` %; a pair at 85 % is missed with probability 4e-7, at 80 % 3e-5, by
    the default bands.  component_id is the smallest doc_id reachable.  Rows that
    repeat a doc_id with the same set give one row; a doc_id with several sets links
    through all of them and gives a row for each.  A NULL doc_id is linked with
    nothing, has component NULL, and is kept.
    """
    made, by_set = _classes(docs, size, percent, bands, rows, by_id=True)
    known = made.where("doc_id IS NOT NULL").distinct().join(by_set.select("digest", "component"), "digest", "left")
    nameless = made.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    rows_out = known.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return rows_out.union(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80, bands: int = 26, rows: int = 5) -> DataFrame:
    """One document of each group of near copies, all columns: the one with the smallest doc_id, of several the one whose
    set has the smallest digest, of rows with that id and set any.

    Rows without a doc_id stay, as do all texts without words but repeats of an id.  An id
    that occurs with different texts does not link them; each is kept or dropped by its own group.
    """
    made, by_set = _classes(docs, size, percent, bands, rows, by_id=False)
    chosen = by_set.groupBy("at").agg(F.min(F.struct("doc_id", "digest")).alias("m")).select("m.doc_id", "m.digest")
    empty = made.where("doc_id IS NOT NULL AND n_shingles = 0").select("doc_id", "digest").distinct()
    kept = chosen.union(empty)
    taken = fresh(docs, "_kept")
    keys = (made.where("doc_id IS NOT NULL").select("doc_id", "digest").distinct().join(kept.withColumn("yes", F.lit(True)), ["doc_id", "digest"], "left")
            .groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("yes"), F.col("digest"))).alias("digests"))
            .where(F.size("digests") > 0).select(F.col("doc_id").alias(taken), "n", "digests"))
    keys = staged(keys.select(taken, F.struct("n", "digests").alias(taken + "_of")), "kept")

    @F.pandas_udf("binary")
    def digest(text):
        import pandas as pd
        from xxhash import xxh3_128_digest

        return pd.Series([xxh3_128_digest(x.tobytes()) for at in range(0, len(text), 500) for x in sets_of(list(text[at:at + 500]), size)])

    named = docs.where("doc_id IS NOT NULL").join(keys, docs["doc_id"].cast("long") == F.col(taken))
    single = named.where(F.col(f"{taken}_of.n") == 1).dropDuplicates([taken]).select(*docs.columns)
    mark = taken + "_digest"
    several = named.where(F.col(f"{taken}_of.n") > 1).withColumn(mark, digest(F.col("text").cast("string")))
    several = several.where(F.array_contains(F.col(f"{taken}_of.digests"), F.col(mark))).dropDuplicates([taken, mark]).select(*docs.columns)
    return single.union(several).union(docs.where("doc_id IS NULL"))
