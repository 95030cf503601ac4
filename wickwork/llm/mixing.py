"""Mixing sources to target weights by the cube method.

Each source gets a token target; a document's expected number of copies is target over source size. The whole part is
certain, the fraction is an inclusion probability. A flight moves the fractions of three documents at a time along the
direction that keeps both their expected tokens and their expected number, until one is decided; so each chunk ends
with at most two undecided documents and exact totals. The undecided meet once more by source, with a few documents of
well spread sizes that the first chunk holds back for it; this small landing problem is solved by trying all choices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import WORD, cut

WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents flown together in one task, on average.
CHUNK = 40_000
#: Documents of a source that one chunk keeps open for landing: 2**(OPEN + 2) choices are tried.
OPEN = 16
_NEAR = 1e-9


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1, and the sums of p and p*size stay."""
    p = p.tolist()
    size, draw = size.tolist(), draw.tolist()
    open_: list[int] = []
    for i in range(len(p)):
        if not _NEAR < p[i] < 1 - _NEAR:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = (size[k] for k in open_)
            u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(open_, u, strict=True) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(open_, u, strict=True) if v)
            step = up if draw[i] * (up + down) < down else -down
            for k, v in zip(open_, u, strict=True):
                p[k] += step * v
                if p[k] < _NEAR:
                    p[k] = 0.0
                elif p[k] > 1 - _NEAR:
                    p[k] = 1.0
            open_ = [k for k in open_ if 0 < p[k] < 1]
    return np.array(p)


def spread(size: np.ndarray, most: int = OPEN) -> np.ndarray:
    """Positions of up to ``most`` documents (sizes in falling order) whose sizes fall in even ratios: they make any sum."""
    size = size[size > 0]
    if len(size) <= most:
        return np.arange(len(size))
    at = np.searchsorted(-size, -np.geomspace(size[0], size[-1], most))
    # Where sizes repeat, the next positions serve.
    for i in range(1, len(at)):
        at[i] = max(at[i], at[i - 1] + 1)
    for i in range(len(at) - 1, -1, -1):
        at[i] = min(at[i], len(size) - len(at) + i)
    return at


def land(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """0 or 1 for all, documents being in falling order of size.

    All fly but a few of well spread sizes. Those, and the two that the flight leaves, are the landing problem: of all
    choices among them the one is taken whose tokens come nearest to what is expected, of equals the one whose number does.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    kept = open_[spread(size[open_])]
    rest = np.setdiff1d(open_, kept)
    p[rest] = fly(p[rest], size[rest], draw[rest])
    last = np.append(rest[(p[rest] > 0) & (p[rest] < 1)], kept)
    if len(last):
        sums, number = np.zeros(1), np.zeros(1)
        for i in last:
            sums, number = np.concatenate([sums, sums + size[i]]), np.concatenate([number, number + 1])
        off = np.abs(sums - (p[last] * size[last]).sum())
        near = np.flatnonzero(off <= off.min() + 1e-6)
        best = near[np.abs(number[near] - p[last].sum()).argmin()]
        p[last] = best >> np.arange(len(last)) & 1
    return p


def _draws(ids: np.ndarray) -> np.ndarray:
    """A reproducible number in [0, 1) for each row."""
    from wickwork.llm.textkernel import mix

    return mix(ids.astype(np.int64).view(np.uint64)).astype(np.float64) / 2.0**64


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row per source: no_source, source_key, source_size, target.

    Sources are ranked by code point, null last; the rank within range partitions plus the counts of earlier
    partitions keeps that distributed. The excess over the caps is reshared in rounds of one aggregate each.
    """
    s = cut(sized.groupBy("no_source", "source_key").agg(F.sum("size").cast("long").alias("source_size")))
    n = s.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = cut(s.repartitionByRange(int(n), "no_source", "source_key").sortWithinPartitions("no_source", "source_key")
                 .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    firsts, before = {}, 0
    for part, rows, first in sorted((r.part, r.n, r.first) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first")).collect()):
        firsts[part] = before - first
        before += rows
    if not firsts:
        return ranged.select("no_source", "source_key", "source_size", F.lit(0.0).alias("target"))
    shift = F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair])
    rank = F.col("row") + shift[F.col("part")]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranged = ranged.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    level = -1.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        r = ranged.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap"))).alias("capped"),
                       F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        new = ((r["all"] or 0) - (r["capped"] or 0.0)) / r["open"] if r["open"] else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return ranged.select("no_source", "source_key", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def _key():
    return F.xxhash64("doc_id", "text", F.col("text").isNull(), F.col("source").isNull(), "source").alias("k")


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The sizes of all rows of ``docs`` (doc_id, text, source and any others), and by row key the copies to take.

    A row is taken 0 to ``most`` times. A null text has size 0; an empty document has
    0 copies. Equal rows are documents of their own. Empty input gives no rows. Reruns on equal input agree.
    """
    sized = cut(docs.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), _key()))
    targets = cut(source_targets(sized, weights, most))
    chunks = max(1, -(-sized.count() // CHUNK))
    # Equal rows have equal keys: they go on as one row with a multiplicity, told apart by a number.
    rows = (sized.groupBy("k", "no_source", "source_key", "size").agg(F.count("*").alias("n"))
            .join(targets, ["no_source", "source_key"])
            .withColumn("ratio", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rows = (rows.withColumn("ratio", F.when(F.abs(F.col("ratio") - F.round("ratio")) < 1e-12, F.round("ratio")).otherwise(F.col("ratio")))
            .withColumn("sure", F.floor("ratio").cast("long")).withColumn("p", F.col("ratio") - F.floor("ratio"))
            .withColumn("total", F.when(F.col("size") > 0, F.col("n") * F.col("p")).otherwise(0.0)))
    # n equal rows with fraction p: floor(n*p) rows surely get one copy more, the rest is one fraction.
    rows = (rows.withColumn("total", F.when(F.abs(F.col("total") - F.round("total")) < 1e-9, F.round("total")).otherwise(F.col("total")))
            .withColumn("more", F.floor("total").cast("long")).withColumn("p", F.col("total") - F.floor("total"))
            .select("k", "no_source", "source_key", "source_size", "target", "size", "n", "sure", "more", "p"))
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")

    def flight(pdf: pd.DataFrame, chunk: int = -1, last: bool = False) -> pd.DataFrame:
        # Largest first, so that what is left open in the end is small.
        pdf = pdf.sort_values(["no_source", "source_key", "size", "k"], ascending=[True, True, False, True]).reset_index(drop=True)
        p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        draw = _draws(pdf["k"].to_numpy())
        for at in pdf.groupby(["no_source", "source_key"], sort=False).indices.values():
            if last:
                p[at] = land(p[at], size[at], draw[at])
                continue
            if chunk == 0:
                open_ = at[(p[at] > _NEAR) & (p[at] < 1 - _NEAR)]
                at = np.setdiff1d(at, open_[spread(size[open_])])
            p[at] = fly(p[at], size[at], draw[at])
        pdf["p"] = p
        return pdf

    flown = cut(rows.withColumn("chunk", F.pmod("k", F.lit(chunks))).groupBy("chunk")
                .applyInPandas(lambda pdf: flight(pdf.drop(columns="chunk"), int(pdf["chunk"].iloc[0])), schema))
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    landed = flown.filter(undecided).groupBy("no_source", "source_key").applyInPandas(lambda pdf: flight(pdf, last=True), schema)
    done = flown.filter(~undecided).unionByName(landed).select("k", "source_size", "target", "n", "sure", (F.col("more") + F.col("p")).cast("long").alias("more"))
    return sized, done


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    sized, done = with_copies(docs, weights, most)
    return _dealt(sized.select("doc_id", "size", "k"), done).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns as they were."""
    _, done = with_copies(docs, weights, most)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key())
    dealt = _dealt(whole, done).filter("copies > 0")
    return dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def _dealt(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Copies of each row; of ``n`` equal rows (rare), ``more`` get one more, told apart by a row number."""
    from pyspark.sql import Window

    single = rows.join(done.filter("n = 1").drop("n"), "k").withColumn("copies", F.col("sure") + F.col("more"))
    several = rows.join(done.filter("n > 1"), "k").withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("k")))
    several = several.withColumn("copies", F.col("sure") + (F.col("nth") <= F.col("more")).cast("long"))
    return single.drop("sure", "more").unionByName(several.drop("sure", "more", "n", "nth"))
