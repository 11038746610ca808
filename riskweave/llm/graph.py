"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweave.llm.common import staged


def _forest(batches):
    """Union-find inside a task: the same components, with one link per node at most."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def links():
        nodes = [x for x in parent if find(x) != x]
        for at in range(0, len(nodes), 50_000):
            some = nodes[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({"a": pa.array(some, pa.int64()), "b": pa.array([find(x) for x in some], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 500_000:  # hand over what is known and start anew: memory stays flat
            yield from links()
            parent.clear()
    yield from links()


def spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A forest with the same components as the links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x
    out = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def flat(edges: DataFrame) -> bool:
    """Does every node hang on one other, which hangs on none?  ``edges`` has a > b; one aggregate, without a join."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    ``links`` has the long columns a and b.  Union-find inside the tasks leaves a forest;
    rounds of large and small stars (each node hangs its larger, then its smaller
    neighbours on the smallest) flatten it in about log(n) rounds; a forest that is flat needs none.  Every round is
    written to the shared folder.  A hub's links are joined, never gathered.
    """
    edges = staged(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "links")
    while not flat(edges):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after ``links`` (a, b; a written table) are added to those in ``found`` (node, component).

    Only links between different components go through the rounds; without any, ``found`` stays as it is.
    """
    def name(side: str) -> DataFrame:
        return found.select(F.col("node").alias(side), F.col("component").alias("c" + side))

    ends = links.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left")
    between = staged(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "links")
    if between.isEmpty():
        return found
    new = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(found, "node", "left_anti")
    larger = components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = found.unionByName(new.select("node", F.col("node").alias("component")))
    return staged(known.join(larger, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "found")
