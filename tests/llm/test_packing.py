import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from riskweave.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, limit=P.LIMIT):
    """Sequences are gapless and within the limit; pieces make up the documents."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    where, of = {}, {}
    for r in rows:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
        of.setdefault(r.doc_id, []).append(r)
    for spans in where.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    for doc_id, text in docs.items():
        want = [*lib.encode(text or "", add_special_tokens=False).ids, P.END_ID]
        pieces = sorted(of[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == want
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert all(r.length == limit for r in pieces[1:]) and (len(pieces) == 1) == (len(want) <= limit)
    return len(where)


def test_documents(spark):
    table = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    docs = dict(zip(table.doc_id.tolist(), table.text))
    docs |= {-1: None, -2: "", -3: "a   b \n c", -4: "  x", -5: "<|endoftext|> a", -6: "word " * 3000, -7: "\x00 a\x00.", -8: "\n\n a\t b"}
    df = spark.createDataFrame([(*r, 5) for r in docs.items()], "doc_id long, text string, length int")
    rows = P.best_fit_packing(df).collect()
    total = sum(r.length for r in rows)
    assert check(rows, docs) <= -(-total // P.LIMIT) + 2


def test_ids_of_short_texts_equal_the_library():
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(PATH), random.Random(9)
    parts = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "tis", "a", "B", "é", "語", " ", "  ", "\n", "\t", ".", "!", "12", "<|endoftext|>", "<|", "\x00", "\x01", "\u3000", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(20_000)] + ["'tis the season", "it's", "<|endoftext|>'s"]
    run = P.encoder(PATH, public_tokenizers.PATTERN, P.special_tokens(PATH))
    for at in range(0, len(texts), 200):
        for text, ids in zip(texts[at:at + 200], run(texts[at:at + 200])):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
    lib.encode_special_tokens = True
    plain = P.encoder(PATH, public_tokenizers.PATTERN)
    for text, ids in zip(texts, plain(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c")], "doc_id long, text string").repartition(3)
    rows = P.best_fit_packing(df).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert P.best_fit_packing(df.limit(0)).collect() == []


def test_checksum_is_unsigned_of_little_endian_ids(spark):
    made = P.pieces(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"))
    row = made.selectExpr("ids", "crc32(ids) AS c").first()
    assert row.c == zlib.crc32(bytes(row.ids))


@pytest.mark.parametrize("seed", range(6))
def test_search_packs_everything_and_beats_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(rng.choice([1, 7, 60, 400]))]
    counts = {s: sizes.count(s) for s in sizes}
    out = P.complete(counts, 100)
    packed = {}
    for f in out:
        assert sum(s * k for s, k in f.items) <= 100
        for s, k in f.items:
            packed[s] = packed.get(s, 0) + k * f.times
    assert packed == counts
    n = sum(f.times for f in out)
    assert P.lower_bound(counts, 100) <= n <= sum(f.times for f in P.best_fit(counts, 100))


def test_search_is_optimal_on_small_cases():
    def best(sizes, bins):
        if not sizes:
            return len(bins)
        found = len(sizes) + len(bins)
        for i in range(len(bins)):
            if bins[i] + sizes[0] <= 20:
                found = min(found, best(sizes[1:], [*bins[:i], bins[i] + sizes[0], *bins[i + 1:]]))
        return min(found, best(sizes[1:], [*bins, sizes[0]]))
    rng = random.Random(3)
    for _ in range(25):
        sizes = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        assert sum(f.times for f in P.complete(counts, 20)) == best(sizes, [])


def test_a_first_path_longer_than_the_budget_is_finished():
    """Best-fit needs one sequence more than the bound; the path that finds it has 22 steps."""
    rng = random.Random(0)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    counts = {s: sizes.count(s) for s in sizes}
    assert sum(f.times for f in P.best_fit(counts, 100)) == 29
    assert sum(f.times for f in P.complete(counts, 100, nodes=1)) == P.lower_bound(counts, 100) == 28


def test_a_sum_is_taken_apart_in_several_ways():
    out = P.completions({60: 1, 40: 1, 30: 1, 10: 1, 25: 1, 15: 1}, 100, 1)
    assert [w for w, _ in out] == [0, 0, 0] and len({f for _, f in out}) == 3 and all(sum(s * k for s, k in f) == 100 for _, f in out)
