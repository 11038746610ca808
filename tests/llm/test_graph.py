import numpy as np
import pytest

from riskweave.llm import graph


def smallest(links):
    low = {}
    for a, b in links:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in links:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.fixture
def written(monkeypatch):
    names, plain = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: names.append(name) or plain(df, name))
    return names


def test_flat_forest_takes_no_round(spark, written):
    links = [(1, 2), (1, 3), (5, 4), (7, 7), (9, 8), (9, 8)]
    out = graph.components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert {r.node: r.component for r in out} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8} and len(out) == 7
    assert written == ["links"]


def test_links_over_many_tasks(spark, written):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2)) if a != b] + [(i, i + 1) for i in range(100, 130)]
    out = graph.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r.node: r.component for r in out} == smallest(links) and len(out) == len(smallest(links))
    assert len(written) > 1


def test_no_links(spark, written):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert written == ["links"]
