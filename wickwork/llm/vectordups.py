"""Near-duplicate vectors of a label by cosine, from int8 tile products with exact error bounds.

Each unit vector is stored as a scale times int8 numbers, with the norm of what that loses. For two vectors the product of
the int8 forms differs from the cosine by at most e1 + (1 + e1) * e2. Tiles are multiplied in int8 (as floats that hold
the integers exactly); only pairs whose bound reaches the threshold are computed again in double precision.

Equal vectors are one node with a count before any tile is made. A label's nodes are dealt into tiles; each pair of tiles
is one group, which returns a count and a local component for each node, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.components import components
from wickwork.llm.neighbours import usable
from wickwork.llm.shared import cut, split_join

THRESHOLD = 0.98
TILE = 2048


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales and the norms of the errors of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Arrays (i, j) of the pairs with cosine of at least ``threshold``; i < j if both are the ``same`` tile."""
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantise(x / norm_x[:, None])
    qy, sy, ey = quantise(y / norm_y[:, None])
    exact = np.float32 if x.shape[1] * 127**2 < 2**24 else np.float64
    fy = qy.astype(exact).T
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        product = (qx[part].astype(exact) @ fy) * (sx[part, None] * sy)
        bound = ex[part, None] + (1 + ex[part, None]) * ey
        i, j = np.nonzero(product + bound >= threshold - 1e-12)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 100_000):
            u, v = i[a : a + 100_000], j[a : a + 100_000]
            cosine = np.einsum("nd,nd->n", x[u], y[v]) / (norm_x[u] * norm_y[v])
            yield u[cosine >= threshold], v[cosine >= threshold]


def _merge(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable, with links (i, j) added to those that ``low`` stands for."""
    while True:
        a, b = low[i], low[j]
        if (a == b).all():
            return low
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their lengths are equal and their cosine is at least
    ``threshold``. Rows that cannot link (null label; null, zero or non-finite vector) have no links and are kept. Equal
    rows link. Other columns are dropped.
    """
    can = usable("embedding") & F.col("label").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"), can.alias("can"))
    live = rows.filter("can").withColumn("dim", F.size("embedding")).withColumn("node", F.xxhash64("label", "dim", "embedding"))
    nodes = cut(live.groupBy("node").agg(*[F.first(c).alias(c) for c in ("label", "dim", "embedding")], F.min("vec_id").alias("first"), F.count("*").alias("copies")))
    tiles = cut(nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    placed = nodes.join(tiles, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "t", "node", "copies", "embedding")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "node"]).reset_index(drop=True)
        a, b, t = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), pdf["t"].to_numpy()
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        copies = pdf["copies"].to_numpy(float)
        split = len(x) if a == b else int((t == a).sum())
        left, right = x[:split], x if a == b else x[split:]
        shift = 0 if a == b else split
        links, low = np.zeros(len(x)), np.arange(len(x))
        for i, j in close_pairs(left, right, threshold, a == b):
            j = j + shift
            links += np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            low = _merge(low, i, j)
        node = pdf["node"].to_numpy()
        out = pd.DataFrame({"node": node, "links": links.astype(np.int64), "root": node[low]})
        return out[out["links"] > 0]

    found = cut(dealt.groupBy("label", "dim", "a", "b").applyInPandas(compare, "node long, links long, root long"))
    classes = components(found.select("node", "root"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.join(counts, "node", "left").join(classes, "node", "left")
             .select("node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("root")))
    known = cut(known)
    roots = cut(known.groupBy("root").agg(F.min("first").alias("component_id")))
    known = cut(known.join(roots, "root").select("node", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    # Only ids are joined, not vectors.
    linked = split_join(cut(live.select("vec_id", "node")), known, "node", "copies").select("vec_id", "n_links", "component_id")
    rest = rows.filter("not can").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
