"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import cut


#: So many contracted edges (2 MB) are left to one task; a bound that never changes a result.
FEW = 1 << 17


class Forest:
    """Union-find within a task; the smallest member names its set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = (a, b) if a < b else (b, a)
        self.up[high] = low
        self.up.setdefault(low, low)
        return True


def _stars(batches):
    """Edges of one partition -> each of its nodes with the smallest it reaches there."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.up)
    roots = [forest.find(x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "component"])


def _contract(batches):
    """Edges of one partition -> a star per component of that partition."""
    for star in _stars(batches):
        u, v = (np.asarray(c) for c in star.columns)
        on = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[on]), pa.array(v[on])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (two long columns, any direction, repeats allowed) -> (node, component): each node that has an edge to
    another, with the smallest node it reaches. The edges of a partition are contracted first. If no more than ``FEW`` are
    left, they are contracted once more, together. Else each round hangs every node's larger neighbours on its smallest
    one, and every node with its smaller neighbours on the smallest of them. Rounds end when the edges stay, after a
    number that grows with the logarithm of the nodes."""
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long"))  # u > v from here on
    if e.count() <= FEW:
        return cut(e.coalesce(1).mapInArrow(_stars, "node long, component long"))
    e = cut(e.distinct())
    state = None
    while True:
        new = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state:
            return cut(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        state = new
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
