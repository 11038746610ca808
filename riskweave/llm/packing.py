"""Best-fit packing of tokenised documents by bin completion.

Tokenising is one pass over the texts.  What packing needs to know about the corpus
is how many pieces there are of each length, at most ``limit`` numbers whatever the
size of the corpus; the branch-and-bound search runs on those.  Its answer is a
list of fillings ("so many sequences that hold these lengths"), again bounded by
the number of lengths.  The pieces then find their place on the executors: each
has a rank among the pieces of its length, and a filling owns an interval of ranks.

Ranks need no sort: a piece is counted inside the task that tokenises it, and the
counts per (length, task) are added up, so a length that a third of all pieces
share stays spread over all tasks.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskweave.llm.common import as_batch, staged

LIMIT = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, nth long"


# --- tokenising ----------------------------------------------------------------

def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a byte-level vocabulary file (``.json``).

    The file writes bytes as printable characters: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 on, in order.
    """
    import json

    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(printable)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def special_tokens(path: str) -> dict[str, int]:
    import json

    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", []) if t.get("special")}


def encoder(path: str, pattern: str, special: dict[str, int] | None = None):
    """texts -> their ids as little-endian uint32 bytes; strings of ``special`` are their token, other ones are text.

    Texts without runs of white space need no look-ahead in the pattern, which makes
    matching much faster.  They are encoded together, parted by a control character
    that is in no token but its own, so that no token crosses it.  The pattern takes that
    character for punctuation, so texts that begin with an apostrophe, where it would hide
    a contraction, are encoded alone, as are those with a special string.
    """
    import tiktoken

    ranks, special = byte_ranks(path), special or {}
    exact = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={})
    crowded = {b for token in ranks if len(token) > 1 for b in token}
    part = next(chr(b) for b in range(0x1F) if b not in crowded and not chr(b).isspace())
    part_id = ranks[part.encode()]
    odd = re.compile("|".join([r"\s\s|\s\Z|\A\s|\A'", *map(re.escape, [part, *special])]))
    raw = lambda ids: array("I", ids).tobytes()

    def run(texts: list[str]) -> list[bytes]:
        alone = [bool(odd.search(t)) for t in texts]
        ids = array("I", plain.encode_ordinary(part.join([t for t, x in zip(texts, alone) if not x])))
        ends = [*np.flatnonzero(np.frombuffer(ids, "<u4") == part_id).tolist(), len(ids)]
        joined, at = ids.tobytes(), 0
        out = []
        for t, x in zip(texts, alone):
            if x:
                out.append(raw(exact.encode(t, allowed_special="all", disallowed_special=())))
            else:
                start, end = (ends[at - 1] + 1 if at else 0), ends[at]
                out.append(joined[4 * start:4 * end])
                at += 1
        return out
    return run


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter."""
    if n <= limit:
        return [(0, n)]
    head = n % limit
    return ([(0, head)] if head else []) + [(s, limit) for s in range(head, n, limit)]


def pieces(docs: DataFrame, path: str | None = None, *, limit: int = LIMIT, end_id: int = END_ID,
           pattern: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), task, nth.

    Strings of special tokens inside a text are those tokens, as the tokenizers library reads
    the file.  A NULL or empty text is a document of the end id alone.  Rows that repeat a
    doc_id are documents of their own.  ``task`` and ``nth`` number the pieces of a
    length inside the task that made them.  Columns other than doc_id and text are
    not read.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                        ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())])

    def tokenise(batches):
        from pyspark import TaskContext

        task, seen, encode, end = TaskContext.get().partitionId(), {}, encoder(path, pattern, special_tokens(path)), np.array([end_id], "<u4").tobytes()
        rows, held = [], 0
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids_of), 200):
                some = [t or "" for t in texts.slice(at, 200).to_pylist()]
                for doc_id, ids in zip(ids_of[at:at + 200], encode(some)):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                        nth = seen.get(length, 0)
                        seen[length] = nth + 1
                        rows.append((doc_id, k, start, length, ids[4 * start:4 * (start + length)], task, nth))
                    held += len(ids)
                if held > 8_000_000:
                    yield as_batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield as_batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, PIECES)


# --- the search, on numbers of pieces per length -------------------------------

@dataclass
class Filling:
    times: int                     # sequences filled this way
    items: tuple[tuple[int, int], ...]  # (length, copies), largest first


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """No packing has fewer sequences: total length, and pairs of large pieces with the space that small ones cannot use."""
    best = -(-sum(k * n for k, n in counts.items()) // limit)
    sizes = sorted(counts)
    for a in [0, *[s for s in sizes if s <= limit // 2]]:
        big = sum(counts[s] for s in sizes if s > limit - a)
        mid = sum(counts[s] for s in sizes if limit // 2 < s <= limit - a)
        room = sum((limit - s) * counts[s] for s in sizes if limit // 2 < s <= limit - a)
        small = sum(s * counts[s] for s in sizes if a <= s <= limit // 2)
        best = max(best, big + mid + max(0, -(-(small - room) // limit)))
    return best


def best_fit(counts: dict[int, int], limit: int) -> list[Filling]:
    """Best-fit decreasing on counts: each sequence takes the largest piece that fits, until none does."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        gap, items = limit, []
        for size in sorted(left, reverse=True):
            copies = min(left[size], gap // size)
            if copies:
                items.append((size, copies))
                gap -= size * copies
        out.append(take(left, items))
    return out


def take(left: dict[int, int], items, share: int = 1) -> Filling:
    """Remove as many copies of a filling as there are pieces for, or that number by ``share``."""
    times = max(1, min(left[s] // k for s, k in items) // share)
    for s, k in items:
        left[s] -= k * times
        if not left[s]:
            del left[s]
    return Filling(times, tuple(items))


def completions(left: dict[int, int], limit: int, width: int, each: int = 3) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, filling) around the largest piece, least waste first: undominated ones of at most ``width`` sums.

    ``reach[i]`` has bit s set if lengths up to the i-th can add up to s.  A sum is
    taken apart from its largest length down, in up to ``each`` ways; the first has
    the largest pieces.
    """
    top = max(left)
    gap = limit - top
    sizes = sorted(s for s in left if s <= gap)
    spare = {s: left[s] - (s == top) for s in sizes}
    reach, mask = [1], (1 << (gap + 1)) - 1
    for s in sizes:
        bits, copies, step = reach[-1], min(spare[s], gap // s), 1
        while copies > 0:
            step = min(step, copies)
            bits |= (bits << (s * step)) & mask
            copies -= step
            step *= 2
        reach.append(bits)

    def ways(i, rest, items):
        if not rest:
            yield items
        for j in range(i - 1, -1, -1):
            s = sizes[j]
            if not rest or not reach[j + 1] >> rest & 1:
                return
            for copies in range(min(spare[s], rest // s), 0, -1):
                if reach[j] >> (rest - copies * s) & 1:
                    yield from ways(j, rest - copies * s, {**items, s: items.get(s, 0) + copies})

    # a length that no filling can use up can be added wherever it fits
    endless = next((s for s in sizes if spare[s] > gap // s), limit + 1)
    out, sums = [], 0
    for total in range(gap, -1, -1):
        if gap - total >= endless or sums >= width:
            break
        if reach[-1] >> total & 1:
            some = [w for w in islice(ways(len(sizes), total, {top: 1}), each) if not dominated(w, left, top, limit)]
            out += [(gap - total, tuple(sorted(w.items(), reverse=True))) for w in some]
            sums += bool(some)
    return out


def dominated(items: dict[int, int], left: dict[int, int], top: int, limit: int) -> bool:
    """Could one more piece be added, or one be swapped for a larger one?"""
    room = limit - sum(s * k for s, k in items.items())
    if not room:
        return False
    spare = [s for s, n in left.items() if n > items.get(s, 0)]
    if any(s <= room for s in spare):
        return True
    inside = [s for s, k in items.items() if s != top or k > 1]
    return any(0 < y - x <= room for x in inside for y in spare)


def complete(counts: dict[int, int], limit: int, *, width: int = 3, nodes: int = 1_500, restarts: int = 8) -> list[Filling]:
    """Bin completion: the largest piece left is filled up first, in order of waste.

    Depth-first; a branch ends when the waste so far leaves no way to beat the best
    packing known, which at first is best-fit decreasing.  A filling is used as
    often as the counts allow, or half as often, so a path has a bounded number of
    steps whatever the corpus.  The first path costs nothing, ``nodes`` bounds what
    is looked at by going back; then come ``restarts`` paths from the open choices
    nearest the root.  Both bound the search, not the result: the incumbent always
    packs everything.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    total, bound = sum(k * n for k, n in counts.items()), lower_bound(counts, limit)
    best = best_fit(counts, limit)
    size = sum(f.times for f in best)
    visited, first = 0, True
    stack = [(dict(counts), [], 0, None)]
    while stack and size > bound:
        if visited >= nodes:
            if not restarts:
                break
            restarts -= 1
            visited, first = nodes - 1, True
            stack.append(stack.pop(0))
        left, path, waste, choices = stack.pop()
        if not left:
            used = sum(f.times for f in path)
            if used < size:
                best, size = path, used
            first = False
            visited += 1
            continue
        if choices is None:
            visited += not first
            choices = [(lost, items, 1) for lost, items in completions(left, limit, width)]
            if min(left[s] // k for s, k in choices[0][1]) > 1:
                choices.append((*choices[0][:2], 2))
        allowed = (size - 1) * limit - total
        deeper = False
        while choices and not deeper:
            (lost, items, share), choices = choices[0], choices[1:]
            rest = dict(left)
            filling = take(rest, items, share)
            wasted = waste + lost * filling.times
            if wasted <= allowed:
                if choices:
                    stack.append((left, path, waste, choices))
                stack.append((rest, [*path, filling], wasted, None))
                deeper = True
        if not deeper:
            visited += first
            first = False
    return best


# --- placing the pieces ----------------------------------------------------------

def intervals(fillings: list[Filling]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, copies per sequence, offset of the first copy)."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for f in fillings:
        offset = 0
        for size, copies in f.items:
            at = used.get(size, 0)
            out.setdefault(size, []).append((at, sequence, copies, offset))
            used[size] = at + copies * f.times
            offset += size * copies
        sequence += f.times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(made: DataFrame, *, limit: int = LIMIT, width: int = 3, nodes: int = 1_500) -> DataFrame:
    """Adds sequence_id and offset to a written table of :func:`pieces`, in place of task and nth.

    Pass on only the columns that are wanted: they travel through one shuffle.
    Sequences are gapless from offset 0.  An empty table gives an empty result.
    """
    counts = {int(r[0]): int(r[1]) for r in made.groupBy("length").count().collect()}  # at most ``limit`` rows
    place = intervals(complete(counts, limit, width=width, nodes=nodes))
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts):
            if len(group):
                size = int(length[group[0]])
                rows = place[size]
                row = rows[np.searchsorted(rows[:, 0], rank[group], side="right") - 1]
                nth = rank[group] - row[:, 0]
                sequence[group] = row[:, 1] + nth // row[:, 2]
                offset[group] = row[:, 3] + nth % row[:, 2] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    spot = placed(F.col("length"), F.col("_base") + F.col("nth"))
    return (made.join(base, ["length", "task"])
            .withColumn("_spot", spot)
            .select(*[c for c in made.columns if c not in ("task", "nth")], "_spot.sequence_id", "_spot.offset"))


def best_fit_packing(docs: DataFrame, path: str | None = None, *, limit: int = LIMIT, end_id: int = END_ID,
                     width: int = 3, nodes: int = 1_500) -> DataFrame:
    """Packs documents into as few sequences of at most ``limit`` tokens as it can.

    Per piece: doc_id, piece (from 0), start (ids of its document before it), length,
    ids (little-endian uint32), sequence_id, offset.  NULL and empty texts are one
    end token; a NULL doc_id stays NULL; repeated rows are packed each.
    """
    made = staged(pieces(docs, path, limit=limit, end_id=end_id), "packing")
    return pack(made, limit=limit, width=width, nodes=nodes)
