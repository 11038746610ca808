import itertools

import numpy as np
import pytest

from riskweave.llm import embedding_dedup as E

PLAIN = "vec_id long, embedding array<float>"


def brute(rows, threshold):
    x = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in rows}
    parent, n = {i: i for i in x}, dict.fromkeys(x, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(x, 2):
        if x[i] @ x[j] >= threshold:
            n[i] += 1
            n[j] += 1
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (n[i], find(i), find(i) == i) for i in x}


def clusters(seed, groups, size, noise, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        middle = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((len(rows), [float(np.float32(v)) for v in middle / np.linalg.norm(middle) + noise * rng.standard_normal(dim)]))
    return rows


def test_recall_and_no_false_links(spark):
    rows = clusters(3, 40, 6, 0.03)
    want = brute(rows, 0.95)
    got = {r.vec_id: r for r in E.linked(spark.createDataFrame(rows, PLAIN), tile=3).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _, _ in want.values()) > 100


def test_tight_group_in_tiles_copies_and_unusable_vectors(spark):
    rows = clusters(1, 3, 20, 0.001)
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [float("inf")] + [1.0] * 23), (2005, [1.0, None]), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in [*rows, rows[3], *odd, (None, rows[0][1])]], PLAIN + ", n_links string")
    want = brute(rows, 0.95) | {i: (0, i, True) for i, _ in odd}
    out = E.linked(df, tile=4).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got.pop(None) == (0, None, True)
    assert len(out) == len(want) + 1
    assert got == want


def test_empty_table(spark):
    assert E.linked(spark.createDataFrame([], PLAIN)).collect() == []


def test_bits_follow_the_data_and_codes_are_balanced():
    assert E.plan(1 << 10, 0.95, 0.01)[0] == 8 and E.plan(1 << 20, 0.95, 0.01)[0] == 18
    sample = np.random.default_rng(0).standard_normal((2000, 16))
    on = (sample - sample.mean(axis=0)) @ E.itq(sample - sample.mean(axis=0), 16, 1) > 0
    assert abs(on.mean(axis=0) - 0.5).max() < 0.1


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_recall_holds_for_vectors_with_a_common_direction(common):
    """Pairs of cosine 0.95 to 0.96 around a mean of squared length ``common``; keys as for 2 ** 16 vectors."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32)) * np.sqrt((1 - common) / 32)
    x[:, 0] += np.sqrt(common)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side[:, 0] *= np.sqrt(1 - common)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.95, 0.96, (2000, 1))
    y = cosine * x + np.sqrt(1 - cosine ** 2) * side
    coder = E.fit(np.concatenate([x, y]), 1 << 16, 0.95, 0.01)
    assert (coder.keys(x) == coder.keys(y)).any(axis=1).mean() >= 0.95


def test_vectors_that_are_all_close_are_all_compared(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in np.eye(16)[0] + 0.05 * rng.standard_normal(16)]) for i in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.linked(spark.createDataFrame(rows, PLAIN), tile=8).collect()}
    assert got == brute(rows, 0.95)
