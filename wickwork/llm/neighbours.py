"""Nearest neighbours by inner product with additive quantisation.

A vector is coded as a sum of one word from each of several full-dimensional codebooks, fitted to residuals on a bounded
sample; a beam search keeps the best partial sums while coding. Scores come from tables of query times word, scaled by the
stored ratio of the true norm to the coded one; the best are ranked again by the exact product.

Rows are dealt out in blocks and the queries in chunks; each block meets each chunk once, and only the best few of a
block leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.shared import cut

#: Fitted on at most this many vectors, those with the least hash of their id.
SAMPLE = 8192
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 4, 4
#: Exactly ranked in each block for each query.
RERANK = 512
BLOCK, CHUNK = 8192, 16384


def _nearest_words(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (0.5 * (book**2).sum(1) - x @ book.T).argmin(1)


def fit(sample: np.ndarray, books: int = BOOKS, n_words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (books, words, dimensions) by k-means on what earlier books leave."""
    rest = sample.astype(np.float32)
    out = []
    for m in range(books):
        rng = np.random.default_rng(m)
        book = rest[rng.choice(len(rest), n_words, replace=len(rest) < n_words)].copy()
        for _ in range(rounds):
            at = _nearest_words(rest, book)
            n = np.bincount(at, minlength=n_words)
            sums = np.zeros_like(book)
            np.add.at(sums, at, rest)
            full = n > 0
            book[full] = sums[full] / n[full, None]
        out.append(book)
        rest = rest - book[_nearest_words(rest, book)]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) and the norms of the coded sums, by beam search over residuals."""
    x = x.astype(np.float32)
    n, row = len(x), np.arange(len(x))[:, None]
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        # |r - w|**2 for each partial sum and word
        cost = (rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (rest @ book.T)
        cost = cost.reshape(n, -1)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, 1)[:, :keep]
        best = np.take_along_axis(best, np.take_along_axis(cost, best, 1).argsort(1), 1)
        source, word = best // len(book), best % len(book)
        rest = rest[row, source] - book[word]
        codes = np.concatenate([codes[row, source], word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0], np.linalg.norm(x - rest[:, 0], axis=1)


def usable(column: str):
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    c = F.col(column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(F.forall(c, finite), F.lit(False)) & F.exists(c, lambda v: v != 0)


def as_matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def build(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Every vector with its codes and scale, as a table."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = as_matrix(part.column(1))
                codes, norms = encode(x, shared.value)
                scale = np.linalg.norm(x, axis=1) / np.maximum(norms, 1e-12)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array([v.tobytes() for v in x], pa.binary())],
                    ["vec_id", "codes", "scale", "vector"])

    return cut(vectors.mapInArrow(run, "vec_id long, codes binary, scale double, vector binary"))


def _every(n: int):
    return F.explode(F.expr(f"sequence(0L, {n - 1}L)"))


def _best(score: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` largest, the earlier of equals first to be taken."""
    if len(score) <= most:
        return np.arange(len(score))
    least = np.partition(score, len(score) - most)[len(score) - most]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: most - len(above)]])


def search(vectors: DataFrame, is_query, k: int = 20, dimensions: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row of ``vectors`` (vec_id, embedding) that
    ``is_query`` picks, among all rows with another vec_id; nearest first, ties to the smaller vec_id.

    Vectors that are null, zero, or hold null or non-finite components take no part; nor do those whose length is not
    ``dimensions`` (by default that of the row with the least vec_id). With no vectors the result is empty.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable("embedding"))
    if dimensions is None:
        first = good.agg(F.min(F.struct("vec_id", F.size("embedding").alias("d"))).alias("f")).first()["f"]
        dimensions = first["d"] if first else 0
    good = good.filter(F.size("embedding") == dimensions)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    out_schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(as_matrix(sample))
    shared = spark.sparkContext.broadcast(books)
    index = build(good, books)
    queries = index.filter(is_query)
    blocks, chunks = -(-index.count() // BLOCK), max(1, -(-queries.count() // CHUNK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).alias("chunk")
    rows = index.select(block, _every(chunks).alias("chunk"), "vec_id", "codes", "scale", "vector")
    asked = queries.select(_every(blocks).alias("block"), chunk, "vec_id", "vector")

    def scan(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(ask):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        data = data.sort_values("vec_id")
        ids, scale = data["vec_id"].to_numpy(), data["scale"].to_numpy(np.float32)
        codes = np.frombuffer(b"".join(data["codes"]), np.uint8).reshape(len(data), -1)
        x = np.frombuffer(b"".join(data["vector"])).reshape(len(data), -1)
        asked = np.frombuffer(b"".join(ask["vector"])).reshape(len(ask), -1)
        out = []
        for at in range(0, len(ask), 64):
            q = asked[at : at + 64]
            approx = np.zeros((len(q), len(ids)), np.float32)
            for m, book in enumerate(shared.value):
                approx += (q.astype(np.float32) @ book.T)[:, codes[:, m]]
            approx *= scale
            for i, query in enumerate(ask["vec_id"].iloc[at : at + 64]):
                at_ = _best(approx[i], RERANK + k)
                at_ = at_[ids[at_] != query]
                exact = x[at_] @ q[i]
                top = np.lexsort((ids[at_], -exact))[:k]
                out.append((np.full(len(top), query), ids[at_[top]], exact[top]))
        return pd.DataFrame({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("query_id", "vec_id", "score"))})

    found = rows.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(scan, out_schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
