import itertools

import numpy as np
import pandas as pd
import pytest

from riskweave.llm import minhash as M
from riskweave.llm.graph import components, merged

SPACE = "\t\n\x0b\x0c\r "


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, now = [], ""
    for c in low + " ":
        if c in SPACE:
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out


def shingle_set(text, size):
    w = words(text)
    n = min(size, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def near(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({})
    return {tuple(r) for r in M.near_duplicates(df, **kw).collect()}


def test_equals_brute_force_on_documents(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(docs.doc_id.tolist(), docs.text))
    assert near(spark, rows, size=3, percent=85) == brute(rows, 3, 85)


def test_chains_and_copies(spark):
    """A chain of edited copies, exact copies, and unlike texts."""
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(0, 500)}" for _ in range(60)]
    rows, now = [], list(base)
    for i in range(25):
        rows.append((100 - i, " ".join(now)))
        now = list(now)
        now[int(rng.integers(0, 60))] = f"new{i}"
    rows += [(200 + i, " ".join(base).upper()) for i in range(5)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "One "), (305, "one two"), (306, "one two")]
    assert near(spark, rows, size=3, percent=85) == brute(rows, 3, 85)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "x y z w"), (2, "a b c d")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, component_id int, digest int")
    got = sorted(M.near_duplicates(df, size=3, percent=85).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 2, None, True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(df).collect() == []


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"word{i % 97}x{i}" for i in range(3000))
    whole = M.sets_of([text], 3)[0]
    monkeypatch.setattr(M, "BLOCK", 1000)
    assert (M.sets_of([text], 3)[0] == whole).all()


def test_word_longer_than_blocks_is_one_word(monkeypatch):
    texts = ["a" * 5_000, "a" * 4_999 + "b c", "x " + "é" * 3_000 + " y z", "Q" * 1_000, "q" * 1_000 + " ", " " + "k" * 999 + " m", "one two\n" * 400]
    whole = M.sets_of(texts, 2)
    for block in (7, 1000):
        monkeypatch.setattr(M, "BLOCK", block)
        M._TABLES.clear()
        assert all((x == y).all() for x, y in zip(M.sets_of(texts, 2), whole))
    M._TABLES.clear()
    assert [len(x) for x in whole] == [1, 1, 3, 1, 1, 1, 2]


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_keys_meet_for_every_alike_pair(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 2**63, 3 * n).astype(np.uint64))
        a = pool[:n]
        swap = int(rng.integers(0, max(1, n // 8) + 1))
        b = np.unique(np.concatenate([a[swap:], pool[n:n + int(rng.integers(0, swap + n // 10 + 1))]]))
        both = len(np.intersect1d(a, b))
        ranks = lambda x: (x % np.uint64(50)).astype(np.int64)
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            met = lambda x: set(zip(*(k.tolist() for k in M.rare_keys(x, ranks(x), percent))))
            assert any((key, 2 if side == 2 else 1 - side) in met(b) for key, side in met(a))


def test_many_pages_on_one_template_and_a_stray(spark):
    """25,000 pages on one template, no two alike: they agree in bands, but no pairs of them are formed."""
    rows = [(i, f"sorry the page you asked for was not found {i}") for i in range(25_000)]
    assert near(spark, rows, size=3, percent=85) == {(i, 8, i, True) for i, _ in rows}
    base = [f"w{i}" for i in range(40)]
    copies = [(i, " ".join([*base, f"end{i}"])) for i in range(3_000)]
    stray = (9_000, " ".join([*base[:34], *(f"other{i}" for i in range(7))]))
    got = near(spark, [*copies, stray], size=3, percent=85)
    assert got == {(i, 39, 0, i == 0) for i, _ in copies} | {(9_000, 39, 9_000, True)}


def test_pairs_formed_across_components_only(spark):
    rng = np.random.default_rng(3)
    common = np.unique(rng.integers(0, 2**62, 100))
    rows = [(i, 0, [int(v) for v in common] + [i]) for i in range(300)] + [(1_000, 1_000, [int(v) for v in common[:95]] + [5_000])]
    sets = spark.createDataFrame(rows, "node long, component long, hashes array<long>")
    assert {tuple(r) for r in M.across(sets, 85).collect()} == {(i, 1_000) for i in range(300)}


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b + " end", "u"), (4, c, "v"), (4, c, "w"), (None, a, "n"), (None, a, "n"), (5, None, "e"), (6, "", "e"), (6, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept string").repartition(4)
    got = M.one_of_each(df)
    assert got.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert found == sorted([(1, a), (1, b), (4, c), (None, a), (None, a), (5, None), (6, "")], key=str)
    assert M.one_of_each(df.limit(0)).collect() == []


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:])
    s = M.super_minhash([a, b], 256)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.12
    assert (M.super_minhash([a], 256)[0] == s[0]).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(4))
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_equals_components_of_all_links(spark, seed):
    """New links are added to known components: nodes known and new, links inside one component, no links at all."""
    rng = np.random.default_rng(seed)
    first, second = ([tuple(map(int, p)) for p in rng.integers(0, 60, (n, 2))] for n in (25, 0 if seed == 3 else 25))
    table = lambda rows: spark.createDataFrame([(a, b) for a, b in rows if a != b], "a long, b long")
    got = {tuple(r) for r in merged(components(table(first)), table(second)).select("node", "component").collect()}
    assert got == {tuple(r) for r in components(table(first + second)).select("node", "component").collect()}
