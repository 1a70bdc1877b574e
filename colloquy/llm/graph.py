"""Connected components of a graph given as rows of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, written


#: Nodes that a task contracts at once; this bounds memory only.
AT_ONCE = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the least node of its own components: never more edges than it got."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    def stars() -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "m"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > AT_ONCE:
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges that is not itself a root, root being the least node it can reach.

    edges has two long columns; order, repetitions and loops don't matter, null ends are left out. Alternates between
    linking each node's larger neighbours and its smaller ones to the least one, until all edges are stars; the number of
    rounds grows with the logarithm of the longest path. Every round is a table in the shared folder; no list of
    neighbours or component is ever in one place: a node gets the minimum over its edges, combined before the shuffle.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("m"))
    pairs = pairs.where("u != m")
    e = written(pairs.mapInArrow(_contracted, "u long, m long").distinct(), "edges")
    while True:
        heads = e.select(F.col("m").alias("u")).distinct()
        if e.join(heads, "u", "left_semi").isEmpty():
            return e.withColumnsRenamed({"u": "node", "m": "root"})
        both = e.union(e.select(F.col("m").alias("u"), F.col("u").alias("m")))
        # A table of its own, so that Spark can split the edges of a node that has very many.
        least = written(both.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("low")), "least")
        large = both.where("m > u").join(least, "u").select(F.col("m").alias("u"), F.col("low").alias("m")).distinct()
        low = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(low, "u").where("m != low").select(F.col("m").alias("u"), F.col("low").alias("m"))
        old, e = e, written(small.union(low.select("u", F.col("low").alias("m"))).distinct(), "edges")
        discard(old)
        discard(least)
