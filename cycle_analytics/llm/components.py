"""Connected components of a link table, without gathering links anywhere.

Each partition first unites its own links with a union-find forest, which leaves one link per node at most. Large
and small stars then alternate (every node's larger neighbours, then its smaller ones, move to its smallest
neighbour) until no node is both a root and a member. Joins carry a node's many links; Spark splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cycle_analytics.session import written


class Forest:
    """Union-find over the nodes of one partition; the smaller root wins."""

    def __init__(self):
        self.parent = {}

    def root(self, node):
        parent = self.parent
        top = node
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def unite(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def united_locally(links: DataFrame) -> DataFrame:
    """The links (low, high) of each partition's forest."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.unite(a, b)
        pairs = [(forest.root(node), node) for node in list(forest.parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in part], kind) for k in (0, 1)], names=["low", "high"]
            )

    return links.mapInArrow(unite, links.schema)


def large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(
        links.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high"))


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("high").agg(F.min("low").alias("m"))
    moved = links.join(least, "high").where("low > m").select(F.col("m").alias("low"), F.col("low").alias("high"))
    return moved.unionAll(least.select(F.col("m").alias("low"), "high")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link (low, high) touches, roots aside; the root is the smallest node reachable."""
    current = written(united_locally(links.where("low <> high").select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"))), "links")
    while True:
        members = current.select(F.col("high").alias("low"))
        if current.join(members, "low", "left_semi").isEmpty() and not twice_rooted(current):
            return current.select(F.col("high").alias("node"), F.col("low").alias("root"))
        current = written(small_star(large_star(current)), "links")


def twice_rooted(links: DataFrame) -> bool:
    """Whether some node has two roots; then its roots are still to be united."""
    return not links.groupBy("high").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a <> b").isEmpty()
