"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tables import durable

#: Edges that one task joins up by itself.
EDGES_AT_ONCE = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the partition's edges but the tops, with the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def top(node: int) -> int:
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = parent[up] if up in parent else up
            node = up
        return node

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    below = [(n, top(n)) for n in list(parent)]
    below = [(n, t) for n, t in below if n != t]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in below], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges (a, b)`` reaches.

    Edges are first joined up within partitions of a bounded number of them, which leaves an edge
    for each node at most. If there is more than one partition, two steps alternate across them
    until nothing changes: every node hangs its larger neighbours on its
    smallest one, then its smaller ones. Minima are pre-aggregated before each shuffle, so a hub
    costs one partial row per task, and the number of rounds grows with the logarithm of the
    longest path. Only three numbers a round reach the driver.
    """

    def hung(links: DataFrame) -> DataFrame:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        return (
            ends.where("b > a").join(least, "a").where("b <> least")
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        )

    def drawn(links: DataFrame) -> DataFrame:  # every link has a > b
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        moved = links.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()

    edges = edges.select("a", "b").where("a <> b")
    parts = max(1, -(-edges.count() // EDGES_AT_ONCE))
    links = durable(edges.repartition(parts).mapInArrow(_forest, "a long, b long"))
    state = None
    while parts > 1:
        links = durable(drawn(hung(links)))
        now = links.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    tops = links.select(F.col("b").alias("a"), "b").distinct()
    return links.unionByName(tops).select(F.col("a").alias("node"), F.col("b").alias("component"))
