"""Connected components of a graph whose edges are rows of a table.

Frontier breadth-first search from many seeds at once: a node that comes before all its
neighbours (by degree, then by a hash) is a seed, seeds spread over the adjacency lists for
a few hops, and where two labels meet, the labels are joined by an edge of a smaller graph.
That graph is treated in the same way until it is small enough for one task. A hub is a seed,
so a hot key takes its whole neighbourhood in one hop; its edges are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut


def _merge_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one task's edges; each node points at the least of its component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch["u"], batch["v"]):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "label": [find(x) for x in nodes]})


def _spread(edges: DataFrame, hops: int) -> DataFrame:
    """A label for each node: a seed within ``hops``, else the node itself."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    rank = both.groupBy("u").agg(F.count("*").alias("degree")).select("u", F.struct("degree", F.xxhash64("u").alias("h"), F.col("u").alias("n")).alias("rank"))
    # The best neighbour of each node; a node that is better still is a seed.
    best = both.join(rank.select(F.col("u").alias("v"), F.col("rank").alias("near")), "v").groupBy("u").agg(F.max("near").alias("near"))
    nodes = cut(rank.join(best, "u").select(F.col("u").alias("node"), (F.col("rank") > F.col("near")).alias("seed")))
    labels = nodes.where("seed").select("node", F.col("node").alias("label"))
    frontier = labels
    for _ in range(hops):
        met = both.join(frontier.withColumnRenamed("node", "u"), "u").groupBy("v").agg(F.min("label").alias("label"))
        frontier = met.withColumnRenamed("v", "node").join(labels.select("node"), "node", "left_anti")
        labels = labels.unionByName(frontier)
    labels = cut(labels)
    rest = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return labels.unionByName(rest)


def components(edges: DataFrame, src: str, dst: str, hops: int = 2, small_graph: int = 200_000) -> DataFrame:
    """``node``, ``component``: for each node of the edges, the least node tied to it.

    Edges have no direction; repeated edges and loops change nothing, rows with a null end are
    ignored, other columns too. ``small_graph`` is the number of edges up to which a contracted
    graph is finished in one task; larger ones take another distributed step.
    """
    kind = dict(edges.dtypes)[src]
    a, b = F.col(src), F.col(dst)
    loops = edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("u"), b.alias("v"))
    left = cut(loops.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    count, maps = left.count(), []
    while count:
        if maps and count <= small_graph:
            maps.append(cut(left.coalesce(1).mapInPandas(_merge_small, f"node {kind}, label {kind}")))
            break
        labels = cut(_spread(left, hops))
        maps.append(labels)
        joined = left.join(labels.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("b")), "v")
        left = cut(joined.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        count = left.count()
    alone = loops.where("u = v").select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    if not maps:
        return alone.withColumnRenamed("label", "component")
    found = maps[-1]
    for m in reversed(maps[:-1]):
        upper = found.select(F.col("node").alias("label"), F.col("label").alias("up"))
        found = m.join(upper, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    tied = found.join(least, "label").select("node", "component")
    lone = alone.join(tied, "node", "left_anti").select("node", F.col("label").alias("component"))
    return tied.unionByName(lone)
