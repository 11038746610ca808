"""Alignment of two tokenizers' tokens over the bytes of each text.

Texts are encoded by a byte-level BPE (A) and a piece model (B); where tokens of both
end at the same byte, the two sequences are cut into groups, and the tokens that end
there are linked.  The merge runs in lockstep: one NumPy state holds the A and B
pointers of all lanes of a batch, every step compares the two ends of each lane,
advances the smaller (both where they meet, which emits a link and a cut) and drops
the lanes that are done.  A lane is a document, or a stretch of a long one: lanes of a
document start where B's ends pass the A end before them, so a cut is found once.

Links per pair of ids are counted over the corpus, and each document's links are
looked up in those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm import packing
from riskweave.llm.common import staged

LANE = 512            # A tokens of a lane
BATCH = 1 << 20       # characters of text that are aligned at a time
ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@dataclass
class Cuts:
    """Of a batch: the positions (in the flat arrays) of the A and B tokens of each link, in the order of texts and bytes."""
    a: np.ndarray
    b: np.ndarray


def lockstep(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray, lane: int = LANE) -> Cuts:
    """Where the tokens of both sides end together.

    ``ends_*`` are byte offsets inside each document, rising, of all documents one after
    the other; ``first_*`` are the documents' first positions, with the total at the end.
    Every token has a byte at least, so an end meets one other end at most.
    """
    starts, stops, others, limits = [], [], [], []
    for d in range(len(first_a) - 1):
        lo, hi, at, end = int(first_a[d]), int(first_a[d + 1]), int(first_b[d]), int(first_b[d + 1])
        if lo == hi or at == end:
            continue
        cut = np.arange(lo, hi, lane)
        starts.append(cut)
        stops.append(np.minimum(cut + lane, hi))
        others.append(at + np.concatenate([[0], np.searchsorted(ends_b[at:end], ends_a[cut[1:] - 1], side="right")]))
        limits.append(np.full(len(cut), end))
    if not starts:
        return Cuts(np.empty(0, np.int64), np.empty(0, np.int64))
    pa_, stop, pb, limit = (np.concatenate(x).astype(np.int64) for x in (starts, stops, others, limits))
    found_a, found_b = [], []
    while True:
        live = (pa_ < stop) & (pb < limit)
        if not live.all():
            pa_, stop, pb, limit = pa_[live], stop[live], pb[live], limit[live]
            if not len(pa_):
                break
        x, y = ends_a[pa_], ends_b[pb]
        meet = x == y
        if meet.any():
            found_a.append(pa_[meet])
            found_b.append(pb[meet])
        pa_ = pa_ + (x <= y)
        pb = pb + (y <= x)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_a, found_b))
    order = np.argsort(a, kind="stable")
    return Cuts(a[order], b[order])


class Side:
    """What a tokenizer's ids stand for: bytes, their number, and the id in decimal with what may follow it."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.names = [str(i).encode() for i in range(len(texts))]

    def followed(self, mark: bytes) -> list[bytes]:
        return [n + mark for n in self.names]


def side_a(path: str) -> Side:
    """The entries of a byte-level vocabulary (``.json``), byte-level decoded."""
    ranks = packing.byte_ranks(path)
    texts = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        texts[i] = token
    return Side(texts)


def side_b(model) -> Side:
    """A piece's UTF-8 bytes, U+2581 as space, byte pieces as their byte; control pieces as they are written."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Side([bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])


class Aligner:
    """Encodes texts both ways and merges the ends; lives in one task."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece

        self.encode_a = packing.encoder(a_path, pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = side_a(a_path), side_b(self.model)
        self.a_more, self.a_last = self.a.followed(b","), self.a.followed(b"|")
        self.b_more, self.b_last = self.b.followed(b","), self.b.followed(b";")

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text; none if the bytes of either are not those of the space and the text."""
        ids_a = self.encode_a([" " + t for t in texts])
        ids_b = self.model.encode(texts, num_threads=1)
        none, out = np.empty(0, np.int64), []
        for text, a, b in zip(texts, ids_a, ids_b):
            data = b" " + text.encode()
            a = np.frombuffer(a, "<u4").astype(np.int64)
            same = bool(text) and b"".join([self.b.texts[i] for i in b]) == data and b"".join([self.a.texts[i] for i in a.tolist()]) == data
            out.append((a, np.array(b, np.int64)) if same else (none, none))
        return out

    def align(self, texts: list[str], lane: int = LANE) -> list[tuple]:
        """Per text: n_a, n_b, n_groups, groups in text form, A ids and B ids of its links."""
        coded = self.encoded(texts)
        a, b = (np.concatenate([c[k] for c in coded]) if coded else np.empty(0, np.int64) for k in (0, 1))
        first_a, first_b = (np.cumsum([0] + [len(c[k]) for c in coded]) for k in (0, 1))

        def ends(ids, first, side):
            total = np.concatenate([[0], np.cumsum(side.lengths[ids])])
            return total[1:] - np.repeat(total[first[:-1]], np.diff(first))

        cuts = lockstep(ends(a, first_a, self.a), first_a, ends(b, first_b, self.b), first_b, lane)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[cuts.a], last_b[cuts.b] = True, True
        # a group's A tokens come before its B tokens: places of both in one list
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, before_a = np.concatenate([[0], cuts.b + 1]), np.concatenate([cuts.a + 1, [len(a)]])
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b]
        parts: list = np.empty(len(a) + len(b), object)
        parts[place_a] = [self.a_last[i] if x else self.a_more[i] for i, x in zip(a.tolist(), last_a.tolist())]
        parts[place_b] = [self.b_last[i] if x else self.b_more[i] for i, x in zip(b.tolist(), last_b.tolist())]
        link = np.searchsorted(cuts.a, first_a)
        link_a, link_b = a[cuts.a], b[cuts.b]
        return [(len(x), len(y), int(j - i), b"".join(parts[s:e])[:-1], link_a[i:j], link_b[i:j])
                for (x, y), i, j, s, e in zip(coded, link, link[1:], first_a[:-1] + first_b[:-1], first_a[1:] + first_b[1:])]


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None, *, lane: int = LANE) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and
    the document's distinct links as two arrays: ``pairs`` (A id * 2^32 + B id) and ``times``.

    A text without tokens (NULL, empty, or not read back by both) has zeros and ''.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        import hashlib

        from pyspark import TaskContext

        worker, row = Aligner(a_path, b_path, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH):
                    size += len(texts[end] or "")
                    end += 1
                found = worker.align([t or "" for t in texts[at:end]], lane)
                counted = [np.unique((x << 32) | y, return_counts=True) for *_, x, y in found]
                offsets = pa.array(np.cumsum([0] + [len(p) for p, _ in counted]).astype(np.int32))
                column = lambda k: pa.array([f[k] for f in found], pa.int64())
                flat = lambda k, t: pa.array(np.concatenate([c[k] for c in counted]), t)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(row, row + len(found)), pa.int64()), ids.slice(at, end - at), column(0), column(1), column(2), column(2),
                    pa.array([hashlib.sha256(f[3]).hexdigest() if f[0] else "" for f in found], pa.string()),
                    pa.ListArray.from_arrays(offsets, flat(0, pa.int64())), pa.ListArray.from_arrays(offsets, flat(1, pa.int32()))], schema=schema)
                row += len(found)
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, ROW + ", pairs array<long>, times array<int>")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, links, best): corpus-wide links of each id pair, and whether they are the most that its B id has."""
    links = made.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links"))
    links = links.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    most = links.groupBy("b").agg(F.max("links").alias("most"))
    return links.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    NULL and empty texts, and texts whose bytes either tokenizer does not give back
    (those that hold U+2581, say), have zeros and ''.  Repeated rows count and are
    returned each; a NULL doc_id stays NULL.  Texts are aligned whole, long ones in
    several lanes.  Columns other than doc_id and text are not read.

    The counts are a written table, one row per distinct pair of ids.  Spark broadcasts it
    while its size on disk is below spark.sql.autoBroadcastJoinThreshold and shuffles
    beyond; a document's links are one row per distinct pair before the join.
    """
    made = staged(aligned(docs, a_path, b_path, pattern), "aligned")
    counts = staged(pair_counts(made), "pair_counts")
    keys = [c.split()[0] for c in ROW.split(", ")]
    each = made.select(*keys, F.explode_outer(F.arrays_zip("pairs", "times")).alias("p")).select(*keys, F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    return (each.join(counts, "pair", "left").groupBy(*keys)
            .agg(F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).cast("long").alias("n_best"),
                 F.coalesce(F.sum(F.col("times") * F.col("links")), F.lit(0)).cast("long").alias("count_sum"))
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
