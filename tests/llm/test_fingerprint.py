import hashlib
import random

import numpy as np
import pytest

from riskweave.llm import fingerprint as M

SCHEMA = "doc_id long, text string"


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def brute(rows):
    """Rows with different ids: {doc_id: (n_chars, edited_sha256, edited, next, common prefix with both)}."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, after, common(text, edited), common(text, after))
    return out


def check(got, rows):
    want = brute(rows)
    texts = {i: t or "" for i, t in rows}
    assert len(got) == len(rows) and {r["doc_id"] for r in got} == set(want)
    for r in got:
        n, sha, edited, after, with_edited, with_next = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"], r["common_chars"], r["common_next"]) == (n, sha, with_edited, with_next)
        fp, fp_edited, fp_next = M.fingerprint(texts[r["doc_id"]]), M.fingerprint(edited), M.fingerprint(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp, fp_edited)
        assert (r["near_edited"], r["near_next"]) == (M.likeness(fp, fp_edited), M.likeness(fp, fp_next))
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (edited == texts[r["doc_id"]])


@pytest.mark.parametrize("bucket_rows", [7, 20_000])
def test_equals_plain_loop_on_documents(spark, bucket_rows):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = M.edits(df, bucket_rows=bucket_rows).collect()
    check(got, [tuple(r) for r in df.collect()])
    assert np.mean([r["near_edited"] for r in got]) > 0.6
    assert np.quantile([r["near_edited"] for r in got if r["n_chars"] >= 3], 0.01) > 0.55


def test_odd_texts_and_clashing_columns(spark):
    rows = [(-(1 << 63), "lowest id, a text"), ((1 << 63) - 1, "highest id 😀 語"), (0, None), (5, ""), (6, "a"), (7, "ab"), (8, "abc"), (9, "abd"),
            (10, "long " * 120_000), (11, "x" * 300_000 + "y"), (12, "\x00\n\x00"), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("h", "bucket", "extra", "v", "place", "target", "n_chars", "fingerprint"):
        df = df.withColumn(c, df["doc_id"])
    for bucket_rows in (1, 3, 100):
        check(M.edits(df, bucket_rows=bucket_rows).collect(), rows)


def test_repeated_ids_and_rows_follow_each_other(spark):
    rows = [(3, f"text {i % 40} of a repeated id") for i in range(120)] + [(None, f"none {i}") for i in range(60)] + [(i, f"other {i}") for i in range(4, 24)] + [(1, "end")]
    got = M.edits(spark.createDataFrame(rows, SCHEMA).repartition(5), bucket_rows=9).collect()
    assert len(got) == len(rows)
    same = {}
    for r in got:
        same.setdefault((r["doc_id"], r["fingerprint"]), []).append(r["near_next"])
    assert len(same) == 40 + 60 + 20 + 1
    # two of three equal rows are followed by their like
    assert all(sorted(v)[1:] == [1.0, 1.0] and min(v) < 1 for (i, _), v in same.items() if i == 3)


def test_no_rows_and_one_row(spark):
    assert M.edits(spark.createDataFrame([], SCHEMA)).collect() == []
    (row,) = M.edits(spark.createDataFrame([(4, "abcdef")], SCHEMA)).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0 and 0 < row["near_edited"] < 1


def test_spans_and_extensions_equal_plain_comparison():
    rng = random.Random(2)
    for text, other in [("".join(rng.choice("ab") for _ in range(200)), "".join(rng.choice("ab") for _ in range(150))),
                        ("ab" * (M.BLOCK + 50), "b" + "ab" * (M.BLOCK // 2 + 9))]:
        p, q = M.Prefixes(text), M.Prefixes(other)
        for _ in range(200):
            i, j = rng.randrange(len(text)), rng.randrange(len(other))
            k = rng.randrange(min(len(text) - i, len(other) - j))
            same = text[i:i + k] == other[j:j + k]
            assert p.equal(i, q, j, k) == same and (p.spans(i, i + k)[0] == q.spans(j, j + k)[0]) == same
        for _ in range(20):
            i, j = rng.randrange(len(text)), rng.randrange(len(other))
            assert p.extension(i, q, j) == common(text[i:], other[j:])
            assert p.extension(i, q, j, back=True) == common(text[:i][::-1], other[:j][::-1])


def test_extensions_of_a_table(spark):
    rows = [("xabcd", 1, "abce", 0), ("same", 4, "same", 4), (None, 0, "a", 0), ("a", None, "a", 0), ("a", 2, "a", 0)]
    got = M.extensions(spark.createDataFrame(rows, "text_a string, at_a long, text_b string, at_b long")).select("forward", "backward").collect()
    assert [tuple(r) for r in got] == [(3, 0), (0, 4), (0, 0), (None, None), (None, None)]


def test_fingerprints_see_edits_in_the_middle_and_unlike_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3_000)]
    text = [rng.choice(words) for _ in range(600)]
    near = list(text)
    for at in (50, 200, 350, 500):
        near[at] = "changed"
    far = [rng.choice(words) for _ in range(600)]
    a, b, c = (M.fingerprint(" ".join(x)) for x in (text, near, far))
    assert M.likeness(a, b) > 0.75 and M.likeness(a, c) < 0.1 and M.likeness(a, a) == 1.0
    assert max(len(x) for x in (a, b, c)) < 600


def test_fingerprints_of_a_table(spark):
    rows = [(1, "text"), (2, None), (None, "text"), (1, "text")]
    got = [tuple(r) for r in M.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(i, len(t or ""), M.fingerprint(t or "")) for i, t in rows]
