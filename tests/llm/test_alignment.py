import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from riskweave.llm import alignment as A

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A_PATH)
    tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {}, 0
    for b in range(256):
        if b in printable:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    with open(A_PATH, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    a_bytes = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if t != "<|endoftext|>"}
    return tok, a_bytes, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain(text, libraries):
    """(A ids, B ids, groups) by a merge with two pointers, or None."""
    tok, a_bytes, sp = libraries
    if not text:
        return None
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    b_text = []
    for i in b:
        piece = sp.id_to_piece(i)
        b_text.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and sp.is_byte(i) else piece.replace("▁", " ").encode())
    a_text = [a_bytes[i] for i in a]
    if b"".join(a_text) != (" " + text).encode() or b"".join(b_text) != (" " + text).encode():
        return None
    groups, i, j, ga, gb, ea, eb = [], 0, 0, [], [], 0, 0
    while i < len(a) or j < len(b):
        if ea <= eb and i < len(a) and not (ea == eb and ga):
            ea += len(a_text[i])
            ga.append(a[i])
            i += 1
        else:
            eb += len(b_text[j])
            gb.append(b[j])
            j += 1
        if ea == eb and ga and gb:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


def brute(rows, libraries):
    made = [(i, plain(t, libraries)) for i, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, m in made if m for g in m[2])
    most = {}
    for (x, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, m in made:
        if not m:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups = m
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def aligned(spark, rows, schema="doc_id long, text string"):
    return Counter(tuple(r) for r in A.align(spark.createDataFrame(rows, schema), A_PATH, B_PATH).collect())


def test_equals_plain_merge_on_documents(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = Counter(tuple(r) for r in A.align(df, A_PATH, B_PATH).collect())
    assert got == brute([tuple(r) for r in df.collect()], libraries)


def test_odd_texts_repeats_and_nulls(spark, libraries):
    rows = [(1, None), (2, ""), (3, " "), (4, "▁ mark"), (5, "<s> a </s> <unk> <|endoftext|> <0x41>"), (6, "'tis don't"), (7, "\n\n  tab\t"),
            (8, "日本語のテキスト 😀👍🏽"), (9, "naïve ÀÉ́ \x00\x01 end"), (10, "same text"), (10, "same text"), (None, "no id"), (11, "  two  spaces  "),
            (12, "a"), (13, "�​"), (14, "x" * 3_000), (15, "word " * 2_000), (16, "語" * 2_000)]
    assert aligned(spark, rows) == brute(rows, libraries)


def test_clashing_columns_and_empty_table(spark, libraries):
    rows = [(1, "one two"), (2, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "pair", "pairs", "times", "n_a", "links", "best", "b"):
        df = df.withColumn(c, df["doc_id"])
    assert Counter(tuple(r) for r in A.align(df, A_PATH, B_PATH).collect()) == brute(rows, libraries)
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_shuffled_counts_give_the_same(spark, libraries):
    rows = [(i, f"the cat {i % 3} sat on the mat, {i % 7} naïve dogs") for i in range(40)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert aligned(spark, rows) == brute(rows, libraries)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lanes_find_each_cut_once():
    rng = np.random.default_rng(1)
    ends_a, ends_b, first_a, first_b, want, at_a, at_b = [], [], [0], [0], [], 0, 0
    for n in (0, 1, 5, 700, 3_000):
        total = n * 3
        a, b = (np.unique(np.append(rng.integers(1, total, n // 2 + 1), total)) if n else np.empty(0, int) for _ in "ab")
        both = np.intersect1d(a, b)
        want += [(at_a + i, at_b + j) for i, j in zip(np.searchsorted(a, both), np.searchsorted(b, both))]
        ends_a.append(a), ends_b.append(b)
        at_a, at_b = at_a + len(a), at_b + len(b)
        first_a.append(at_a), first_b.append(at_b)
    for lane in (1, 7, 512, 10_000):
        cuts = A.lockstep(np.concatenate(ends_a), np.array(first_a), np.concatenate(ends_b), np.array(first_b), lane)
        assert list(zip(cuts.a.tolist(), cuts.b.tolist())) == want
