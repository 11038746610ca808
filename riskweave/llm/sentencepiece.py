"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut where no piece holds the two characters in a row; such parts ("atoms": words,
and the punctuation between them) can be encoded apart.  The distinct atoms are exploded into their
substrings of bounded length and joined to the piece table; that gives the edges of a
lattice, grouped by atom.  A higher-order fold over an atom's edges picks its pieces,
and leaves them as one long whose set bits are the boundaries:

* unigram models: Viterbi, edges by their end, the best score at each position;
* BPE models: edges by score, each applied if it joins exactly two pieces that stand
  there by then.  Viterbi would maximise the sum of scores, which is not what a BPE
  model encodes.

A chunk has about ``chunk_bytes`` of text.  It sends its own distinct atoms to their buckets, one string each, where an
atom that many chunks hold is solved once, and gets their ids back in that order.  Its texts travel compressed and are put
together from its own atoms, so no vocabulary is held whole anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.llm.common import Cache, as_batch, let

MARK = "\u2581"
WIDTH = 61            # characters of an atom whose boundaries fit a long


@dataclass
class Pieces:
    """The table of a model file: normal pieces, the id of byte 0, and what ids decode to."""
    rows: list[tuple[str, int, float]]
    byte0: int
    unknown: int
    texts: list[bytes]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        normal = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in normal]
        if any("\n" in p or MARK in p.lstrip(MARK) for p, _, _ in rows):
            raise ValueError("pieces that go across words are not supported")
        byte = [i for i in ids if sp.is_byte(i)]
        texts = [b"" if sp.is_control(i) else " \u2047 ".encode() if sp.is_unknown(i) else bytes([i - byte[0]]) if sp.is_byte(i)
                 else sp.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        return cls(rows, byte[0] if byte else -1, sp.unk_id(), texts)



def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def follows(pieces: Pieces) -> set[str]:
    """Pairs of characters that stand side by side in a piece; elsewhere texts can be cut."""
    return {p[i:i + 2] for p, _, _ in pieces.rows for i in range(len(p) - 1)}


def atom_pattern(inside: set[str]) -> str:
    """A pattern whose matches cover a marked text and are cut between characters that no piece holds in a row only.

    No piece holds a line feed or has a mark after another character (checked at loading).  ASCII
    letters and signs that no piece joins to one are apart; other characters go with both.
    """
    letters = {chr(c) for c in range(65, 123) if chr(c).isalpha()}
    signs = {chr(c) for c in range(33, 127)} - letters
    signs -= {c for pair in inside if pair[0] in letters or pair[1] in letters for c in pair}
    some = "".join(f"\\x{ord(c):02x}" for c in sorted(signs)) or MARK
    run, other = rf"(?:[A-Za-z]+|[{some}]+)", rf"[^{MARK}\nA-Za-z{some}]+"
    return rf"{MARK}*(?:{run}(?:{other}{run}?)*|(?:{other}{run}?)+)|{MARK}+|\n"


def cut(atom: str, inside: set[str]) -> list[str]:
    """The parts of an atom: of a long one, wherever no piece goes across."""
    if len(atom) <= WIDTH:
        return [atom]
    at = [0, *(i for i in range(1, len(atom)) if atom[i - 1:i + 1] not in inside), len(atom)]
    return [atom[i:j] for i, j in zip(at, at[1:])]


def lattice(atoms: DataFrame, pieces: Pieces, shortest: int = 1) -> DataFrame:
    """``atoms`` (with a column atom of at least ``shortest`` characters) by every place of a piece in it: start, stop,
    score, and rank (equal scores have equal ranks, the best is 0).

    The piece table is broadcast; it is as large as the vocabulary, whatever the corpus.
    """
    longest = max(len(p) for p, _, _ in pieces.rows)
    ranks = {v: k for k, v in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    known = atoms.sparkSession.createDataFrame([(p, ranks[s], s) for p, _, s in pieces.rows if len(p) >= shortest], "piece string, rank long, score double")
    placed = atoms.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("atom") - shortest)))
    spans = placed.withColumn("stop", F.explode(F.sequence(F.col("start") + shortest, F.least(F.col("start") + longest, F.length("atom")))))
    return spans.join(F.broadcast(known), F.substring("atom", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("piece"))


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def boundaries(atoms: DataFrame, pieces: Pieces) -> DataFrame:
    """BPE: (the columns of ``atoms``, mask) of atoms of 2 to WIDTH characters in which pieces meet; bit i of the mask is
    set if a piece starts or ends at i.  An edge is one long (rank, start, stop), so sorting is by rank, then from the left."""
    keys = atoms.columns
    edge = F.shiftleft("rank", 12).bitwiseOR(F.shiftleft(F.col("start").cast("long"), 6)).bitwiseOR(F.col("stop").cast("long"))
    grouped = lattice(atoms, pieces, 2).select(*keys, edge.alias("edge")).groupBy(*keys).agg(F.collect_list("edge").alias("edges"))

    def step(state: Column, e: Column) -> Column:
        start, stop = F.shiftright(e, 6).bitwiseAND(F.lit(63)).cast("int"), e.bitwiseAND(F.lit(63)).cast("int")
        ends = bit(start).bitwiseOR(bit(stop))
        middle = state.bitwiseAND(bit(stop) - bit(start + 1))
        joins = (state.bitwiseAND(ends) == ends) & (middle != 0) & (middle.bitwiseAND(middle - 1) == 0)
        return F.when(joins, state.bitwiseXOR(middle)).otherwise(state)

    return grouped.select(*keys, F.aggregate(F.sort_array("edges"), bit(F.length("atom") + 1) - 1, step).alias("mask"))


def put(array: Column, at: Column, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == at, value).otherwise(x))


def viterbi(word: Column, edges: Column, unknown_score: float) -> Column:
    """Unigram: array of (start, stop, id) of the best path; NULL ids are characters that are no piece."""
    def folded(known: Column) -> Column:
        n = F.length(word)
        missing = F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(known, i)), lambda i: F.struct(
            F.lit(unknown_score).alias("score"), i.alias("start"), (i + 1).alias("stop"), F.lit(None).cast("int").alias("id")))
        ordered = F.sort_array(F.transform(F.concat(edges, missing), lambda e: F.struct(
            e["stop"].alias("stop"), e["start"].alias("start"), e["score"].alias("score"), e["id"].alias("id"))))
        # what is known of a position: the best sum, and the last piece on the way
        nothing = F.struct(F.lit(float("-inf")).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(None).cast("int").alias("id"))
        origin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(None).cast("int").alias("id"))

        def step(best: Column, e: Column) -> Column:
            total = F.get(best, e["start"])["sum"] + e["score"]
            new = F.struct(total.alias("sum"), e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id"))
            return F.when(total > F.get(best, e["stop"])["sum"], put(best, e["stop"], new)).otherwise(best)

        def back(best: Column) -> Column:
            walk = F.aggregate(F.reverse(F.sequence(F.lit(1), n)), F.struct(n.alias("at"), F.array().cast("array<struct<start:int,stop:int,id:int>>").alias("path")), lambda s, i: F.when(
                s["at"] == i, F.struct(F.get(best, i)["start"].alias("at"), F.concat(F.array(F.struct(F.get(best, i)["start"].alias("start"), i.alias("stop"), F.get(best, i)["id"].alias("id"))), s["path"]).alias("path"))).otherwise(s))
            return walk["path"]
        return let(F.aggregate(ordered, F.concat(F.array(origin), F.array_repeat(nothing, n)), step), back)

    return let(F.transform(F.filter(edges, lambda e: e["stop"] - e["start"] == 1), lambda e: e["start"]), folded)


def best_boundaries(atoms: DataFrame, pieces: Pieces) -> DataFrame:
    """Unigram: (the columns of ``atoms``, mask) of atoms of up to WIDTH characters that hold a piece, by the Viterbi fold."""
    keys = atoms.columns
    edges = lattice(atoms, pieces).select(*keys, F.struct("score", "start", "stop", F.lit(0).alias("id")).alias("edge")).groupBy(*keys).agg(F.collect_list("edge").alias("edges"))
    path = viterbi(F.col("atom"), F.col("edges"), lowest(pieces))
    return edges.select(*keys, F.aggregate(path, F.lit(1).cast("long"), lambda mask, p: mask.bitwiseOR(bit(p["stop"]))).alias("mask"))


def lowest(pieces: Pieces) -> float:
    return min(s for _, _, s in pieces.rows) - 10.0


class Assembler:
    """Ids of words from the boundaries of their atoms; lives in one task."""

    def __init__(self, pieces: Pieces, inside: set[str], model: str):
        self.ids = {p: np.array([i], "<i4").tobytes() for p, i, _ in pieces.rows}
        self.scores = {p: s for p, _, s in pieces.rows}
        self.longest = max(map(len, self.scores))
        self.lowest, self.byte0, self.unknown, self.inside, self.model = lowest(pieces), pieces.byte0, pieces.unknown, inside, model

    def piece(self, text: str) -> bytes:
        """The id of a piece; a character that is none becomes its bytes (or the unknown id)."""
        known = self.ids.get(text)
        if known is not None:
            return known
        return np.array([b + self.byte0 for b in text.encode()] if self.byte0 >= 0 else [self.unknown], "<i4").tobytes()

    def atom(self, atom: str, masks: dict[str, int]) -> bytes:
        if len(atom) > WIDTH:
            cuts = self.long_merge(atom) if self.model == "bpe" else self.long_path(atom)
            return b"".join([self.piece(atom[i:j]) for i, j in zip(cuts, cuts[1:])])
        mask = masks.get(atom)
        if mask is None:                    # no piece joins two of its characters, or the chunk was dealt otherwise
            cuts = self.long_merge(atom) if self.model == "bpe" else self.long_path(atom)
            return b"".join([self.piece(atom[i:j]) for i, j in zip(cuts, cuts[1:])])
        bits, out, i = f"{mask:b}"[::-1], [], 0
        while (j := bits.find("1", i + 1)) > 0:
            out.append(self.ids.get(atom[i:j]) or self.piece(atom[i:j]))
            i = j
        return b"".join(out)

    def long_merge(self, atom: str) -> list[int]:
        """BPE of an atom whose boundaries do not fit a long: a heap of joinable neighbours, n log n."""
        import heapq

        n = len(atom)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(i):
            if i >= 0 and after[i] < n:
                score = self.scores.get(atom[i:after[after[i]]])
                if score is not None:
                    heapq.heappush(heap, (-score, i, after[after[i]]))
        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != stop:
                continue
            alive[j], after[i] = False, stop
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        return [*(i for i in range(n) if alive[i]), n]

    def long_path(self, atom: str) -> list[int]:
        """Viterbi of such an atom; a position looks back by the length of a piece."""
        n = len(atom)
        best, came = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                score = self.scores.get(atom[i:j], self.lowest if j - i == 1 else None)
                if score is not None and best[i] + score > best[j]:
                    best[j], came[j] = best[i] + score, i
        cuts = [n]
        while cuts[-1]:
            cuts.append(came[cuts[-1]])
        return cuts[::-1]


def read_back(ids: bytes, texts: np.ndarray) -> str:
    return b"".join(texts[np.frombuffer(ids, "<i4")].tolist()).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, pieces: Pieces, *, model: str = "bpe", chunk_bytes: int = 4 << 20, buckets: int = 128, decoded: bool = False) -> DataFrame:
    """Per row: doc_id, text, ids (little-endian int32); with ``decoded`` also what the ids decode to, in the same pass.

    NULL and empty texts have no ids; repeated rows are encoded each.

    A text is never divided: one beyond ``chunk_bytes`` is a chunk of its own.  Columns
    other than doc_id and text are not read.  An atom belongs to one of ``buckets`` by its digest, where
    the chunks' atoms meet; a bucket's distinct atoms are in one task at a time.  ``docs`` is read twice, for atoms and for
    texts; where its rows come in another order the second time, what a chunk then lacks is merged in place, with the same ids.
    """
    import re
    from itertools import chain
    from zlib import crc32

    import pyarrow.compute as pc

    inside = follows(pieces)
    shape = atom_pattern(inside)
    pattern, apart = re.compile(shape), f"|[{MARK}]+)" not in shape
    ids_type = "<u2" if max(pieces.byte0 + 255, pieces.unknown, *(i for _, i, _ in pieces.rows)) < 65536 else "<i4"
    texts_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    sent_schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("atoms", pa.string())])
    solved_schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def chunks(batches):
        from pyspark import TaskContext

        chunk, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = len((row[1] or "").encode())
                if rows and size + more > chunk_bytes:
                    yield chunk, rows
                    chunk, rows, size = chunk + 1, [], 0
                rows.append(row)
                size += more
        if rows:
            yield chunk, rows

    def packed(batches):
        for chunk, rows in chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts_schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
                writer.write_batch(as_batch(rows, texts_schema))
            yield pa.RecordBatch.from_pydict({"of": pa.array([chunk], pa.int64()), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def single(text: str) -> bool:
        """Is every mark of the marked text alone?  Then its atoms are those of its words, each with its mark."""
        return apart and text[0] != " " and "  " not in text and MARK not in text

    def parts_of(marked_text: str) -> list[str]:
        found = pattern.findall(marked_text)
        return found if len(marked_text) <= WIDTH else [p for a in found for p in cut(a, inside)]

    def divided(texts: list) -> tuple[list[list[str]], np.ndarray, list[list[str]], list[list[str]]]:
        """Texts in parts: those of the distinct words of single texts, and the codes of all their words; those of each
        other text; and the distinct ones that can have a mask, by bucket."""
        words = pc.split_pattern(pa.array([t for t in texts if t and single(t)], pa.string()), " ").flatten().dictionary_encode()
        of_words = [parts_of(w) for w in pc.binary_join_element_wise(pa.scalar(MARK), words.dictionary, "").to_pylist()]
        others = [parts_of(marked(t)) for t in texts if t and not single(t)]
        out = [[] for _ in range(buckets)]
        for p in dict.fromkeys(chain.from_iterable(of_words + others)):
            if shortest <= len(p) <= WIDTH and p != "\n":
                out[crc32(p.encode()) % buckets].append(p)
        return of_words, words.indices.to_numpy(), others, out

    def distinct(batches):
        for chunk, rows in chunks(batches):
            if sent := [(chunk, k, "\n".join(some)) for k, some in enumerate(divided([t for _, t in rows])[-1]) if some]:
                yield as_batch(sent, sent_schema)

    shortest = 2 if model == "bpe" else 1
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = rows.mapInArrow(distinct, "chunk long, bucket int, atoms string").repartition(buckets, "bucket")
    # an atom's first chunk goes along, so that both uses of ``sent`` read the same columns and share its exchange
    atoms = (sent.select(F.col("bucket").alias("home"), F.explode(F.split("atoms", "\n")).alias("atom"), F.col("chunk").alias("since"))
             .groupBy("home", "atom").agg(F.min("since").alias("since")))
    known = boundaries(atoms, pieces) if model == "bpe" else best_boundaries(atoms, pieces)
    plain_pieces, texts_of = Pieces(pieces.rows, pieces.byte0, pieces.unknown, []), pieces.texts if decoded else []
    workers: list[Assembler] = []       # one in a task

    def assembler() -> Assembler:
        if not workers:
            workers.append(Assembler(plain_pieces, inside, model))
        return workers[0]

    def solved(sent: pa.Table, found: pa.Table) -> pa.Table:
        masks, worker, out = dict(zip(found.column("atom").to_pylist(), found.column("mask").to_pylist())), assembler(), []
        coded = Cache(lambda a: worker.atom(a, masks))
        for chunk, bucket, some in zip(*(sent.column(c).to_pylist() for c in ("chunk", "bucket", "atoms"))):
            ids = [coded[a] for a in some.split("\n")]
            # at most four ids a character, so a size fits a byte
            out.append((chunk, bucket, crc32(some.encode()), bytes([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<i4").astype(ids_type).tobytes()))
        return pa.Table.from_batches([as_batch(out, solved_schema)])

    columns = {"doc_id": pa.int64(), "text": pa.string(), "ids": pa.binary(), **({"decoded": pa.string()} if decoded else {})}

    def assembled(texts: pa.Table, found: pa.Table) -> pa.Table:
        got = {row[0]: row[1:] for row in zip(*(found.column(c).to_pylist() for c in ("bucket", "digest", "sizes", "ids")))}
        worker, out, meant = assembler(), [], np.array(texts_of, object)
        for blob in texts.column("texts").to_pylist():
            for batch in pa.ipc.open_stream(blob):
                these, known = batch.column(1).to_pylist(), {}
                of_words, codes, others, sent = divided(these)
                for k, some in enumerate(sent):
                    digest, sizes, ids = got.get(k, (None, b"", b""))
                    if some and digest == crc32("\n".join(some).encode()):
                        ends, ids = (4 * np.cumsum(np.frombuffer(sizes, "u1"), dtype=np.int64)).tolist(), np.frombuffer(ids, ids_type).astype("<i4").tobytes()
                        known.update(zip(some, [ids[i:j] for i, j in zip([0, *ends], ends)]))
                part = Cache(lambda p: worker.atom(p, {}))
                each = [b"".join([known[p] if p in known else part[p] for p in parts]) for parts in of_words]
                # the words' ids one after the other, as the codes say
                size = np.fromiter(map(len, each), np.int64, len(each)) // 4
                many = size[codes]
                ends = np.cumsum(many)
                places = np.repeat((np.cumsum(size) - size)[codes] - ends + many, many) + np.arange(int(many.sum()))
                flat, at, coded = np.frombuffer(b"".join(each), "<i4")[places].tobytes(), 0, []
                stops, others = np.concatenate([[0], 4 * ends]).tolist(), iter(others)
                for t in these:
                    if t and single(t):
                        upto = at + t.count(" ") + 1
                        coded.append(flat[stops[at]:stops[upto]])
                        at = upto
                    else:
                        coded.append(b"".join([known[p] if p in known else part[p] for p in next(others)]) if t else b"")
                more = {"decoded": pa.array([read_back(ids, meant) for ids in coded], pa.string())} if decoded else {}
                out.append(pa.table({"doc_id": batch.column(0), "text": batch.column(1), "ids": pa.array(coded, pa.binary()), **more}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in columns.items()})

    parts = sent.groupBy("bucket").cogroup(known.groupBy("home")).applyInArrow(solved, "chunk long, bucket int, digest long, sizes binary, ids binary")
    return (rows.mapInArrow(packed, "of long, texts binary").groupBy("of").cogroup(parts.groupBy("chunk"))
            .applyInArrow(assembled, "doc_id long, text string, ids binary" + (", decoded string" if decoded else "")))


def decode(coded: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds ``decoded`` to a table with doc_id, text and ids: pieces' texts, bytes joined, the first space dropped.

    No ids decode to an empty text; bytes that are no UTF-8 become U+FFFD; repeated rows and
    NULL doc_ids are decoded each.  Other columns are dropped.
    """
    texts = np.array(pieces.texts, object)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, ids in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((doc_id, text, ids, read_back(ids, texts)))
            yield as_batch(rows, schema)

    return coded.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids binary, decoded string")
