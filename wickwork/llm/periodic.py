"""Periodic runs of words, found as maximal pairs.

A run of period q and length m is, seen from its first word s, a pair of places (s, s + q) at which the same m - q words
begin, with different words before both and after both: a maximal pair. So runs are read off the suffixes of a text:

* The suffixes are sorted (ranks of 1, 2, 4 ... times the first key), and the lengths that neighbours share form the tree of
  LCP intervals. It is walked bottom-up; each interval holds its places in text order, every place with the class of the
  word to its left. When children meet at depth l, a place of one and a place of another are a pair of exactly l shared
  words; they count if their classes differ and if their distance q satisfies l + q >= max(least, times * q).
* For ``times`` >= 3 a partner at such a distance is always a direct neighbour in text order: a third occurrence between both
  would give the pair a smaller period. So each place of the smaller list looks at two neighbours, not at whole classes.
* Nothing is extended or compared afterwards: length l + q, period q and start s are the run.

Intervals too shallow for any run, those whose places all share one left word, and those whose places are too far apart for
their depth cannot hold a pair and are skipped before the walk.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.textkernel import Hashes, chunks, mix, words

LEAST, TIMES = 6, 4


class Suffixes:
    """Sorted suffixes of several rows of words that share at least ``near`` words with another suffix of their row."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, near: int):
        rows = len(off) - 1
        self.rows_at = off[:-1] + np.arange(rows)
        n = len(ids) + rows
        body = np.ones(n, bool)
        ends = off[1:] + np.arange(rows)
        body[ends] = False
        row = np.repeat(np.arange(rows), np.diff(off))
        # A word of one row never equals a word of another, and each row ends with a symbol of its own.
        known, symbol = np.unique(mix(ids ^ mix(row.astype(np.uint64) + np.uint64(1))), return_inverse=True)
        self.x = x = np.empty(n, np.int64)
        x[body], x[ends] = symbol + rows, np.arange(rows)
        bits = max(int(len(known) + rows).bit_length(), 1)
        h = first = max(1, min(near, 62 // bits))
        key = np.zeros(n, np.int64)
        for t in range(h):
            key = (key << bits) | x[np.minimum(np.arange(n) + t, n - 1)]
        by = np.argsort(key)
        new = np.append(True, key[by][1:] != key[by][:-1]) if n else np.empty(0, bool)
        rank = np.empty(n, np.int64)
        rank[by] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
        alone = new & np.append(new[1:], True) if n else new
        tied = np.sort(by[~alone])
        self.levels, shared = [(h, rank.astype(np.int32))], tied
        while len(tied):
            key = rank[tied] * n + rank[tied + h]
            by = np.argsort(key)
            key, group, i = key[by], rank[tied[by]], np.arange(len(by))
            new = np.append(True, key[1:] != key[:-1])
            start = np.append(True, group[1:] != group[:-1])
            rank = rank.copy()
            rank[tied[by]] = group + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(start, i, 0))
            tied = np.sort(tied[by[~(new & np.append(new[1:], True))]])
            h *= 2
            self.levels.append((h, rank.astype(np.int32)))
        self.order = shared[np.argsort(rank[shared])]
        self.shared = self._shared(self.order[:-1], self.order[1:], first)

    def _shared(self, a: np.ndarray, b: np.ndarray, first: int) -> np.ndarray:
        """The number of words that the suffixes at ``a`` and ``b`` share, from the ranks of each level."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for h, rank in reversed(self.levels):
            step = np.where(rank[a] == rank[b], h, 0)
            a, b, total = a + step, b + step, total + step
        going = np.ones(len(a), bool)
        for _ in range(first - 1):
            going = going & (self.x[a] == self.x[b])
            a, b, total = a + going, b + going, total + going
        return total


def _walk(order: list[int], shared: list[int], left: list[int], least: int, times: int, out: list[tuple[int, int, int]]) -> None:
    """One LCP-interval tree bottom-up; ``shared[i]`` is between order[i - 1] and order[i]. A node is [places, their left
    word or None if they differ]."""

    def meet(a, b, depth):
        (big, small) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        places, few = big[0], small[0]
        if len(few) > 16:
            places = places + few
            places.sort()
        else:
            for p in few:
                insort(places, p)
        if big[1] is None or big[1] != small[1]:
            own = few if len(few) == 1 else set(few)
            for p in few:
                i = bisect_left(places, p)
                for j in (i - 1, i + 1):
                    if 0 <= j < len(places) and places[j] not in own and left_of[places[j]] != left_of[p]:
                        q = abs(places[j] - p)
                        if depth + q >= max(least, times * q):
                            out.append((min(p, places[j]), depth + q, q))
        return [places, big[1] if big[1] == small[1] else None]

    left_of = dict(zip(order, left, strict=True))
    stack: list[list] = []
    node = [[order[0]], left[0]]
    for k in range(1, len(order)):
        depth = shared[k]
        while stack and stack[-1][0] > depth:
            at, top = stack.pop()
            node = meet(top, node, at)
        if stack and stack[-1][0] == depth:
            stack[-1][1] = meet(stack[-1][1], node, depth)
        else:
            stack.append([depth, node])
        node = [[order[k]], left[k]]
    while stack:
        at, top = stack.pop()
        node = meet(top, node, at)


def find_runs(ids: np.ndarray, off: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of all runs of the rows of word ids (unsigned, equal for equal words), sorted."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found through neighbours")
    near = min(max(least, times * q) - q for q in range(1, max(least, 2) + 1))
    s = Suffixes(ids, off, near)
    out: list[tuple[int, int, int]] = []
    if len(s.order) > 1:
        new = np.append(True, s.shared < near)  # a new tree
        tree = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        left = s.x[s.order - 1]
        left[s.order == 0] = -1
        deep = np.maximum.reduceat(np.append(0, np.where(s.shared < near, 0, s.shared)), heads)
        by = np.lexsort((s.order, tree))
        gap = np.append(s.order.max() + 1, np.diff(s.order[by]))
        gap[heads] = len(s.x)
        hopeful = ((np.minimum.reduceat(gap, heads) * (times - 1) <= deep)
                   & (np.minimum.reduceat(left, heads) != np.maximum.reduceat(left, heads)))
        tails = np.append(heads[1:], len(tree))
        for i in np.flatnonzero(hopeful):
            lo, hi = heads[i], tails[i]
            _walk(s.order[lo:hi].tolist(), [0, *s.shared[lo : hi - 1].tolist()], left[lo:hi].tolist(), least, times, out)
    at, length, period = np.array(out, np.int64).reshape(-1, 3).T
    row = np.searchsorted(s.rows_at, at, "right") - 1
    start = at - s.rows_at[row]
    by = np.lexsort((period, start, row))
    return row[by], start[by], length[by], period[by]


_KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (array of start, length, period, by start and period) and
    collapsed, the text's words joined by one space without what a run repeats after its first period.

    A run is a stretch of words with smallest period q and at least max(``least``, ``times`` * q) words that no neighbouring
    word extends. Null text has no words. Equal rows are each judged alone, so ids may be null or repeat. Other columns are
    dropped. Each text is worked on where it is read; nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, hi, data, byte_off in chunks(batch.column(1)):
                start, end, row = words(data, byte_off)
                off = np.searchsorted(row, np.arange(hi - lo + 1))
                r, s, m, q = find_runs(Hashes(data).of(start, end), off, least, times)
                # Words in the repeated part of a run.
                depth = np.zeros(len(start) + 1, np.int32)
                np.add.at(depth, off[r] + s + q, 1)
                np.add.at(depth, off[r] + s + m, -1)
                kept = np.cumsum(depth[:-1]) == 0
                edge = np.zeros(len(data) + 1, np.int32)
                edge[start[kept]] += 1
                edge[end[kept]] -= 1
                keep = np.cumsum(edge[:-1]) > 0
                # The blank behind a kept word becomes the space between it and the next one.
                behind = end[kept]
                behind = behind[behind < byte_off[row[kept] + 1]]
                bytes_ = data.copy()
                bytes_[behind] = 32
                keep[behind] = True
                left = np.append(0, np.cumsum(keep))[byte_off]
                bytes_ = bytes_[keep].tobytes()
                texts = [bytes_[u:v].rstrip(b" ").decode() for u, v in zip(left[:-1], left[1:], strict=True)]
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(hi - lo + 1)), pa.int32()),
                                                pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (s, m, q)], fields=list(_KIND)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(off), pa.int64()), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which one id of ten, chosen by crc32, gets a text that ends in a run: with h the crc32 of
    the id, g = h div 10, n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i >= a becomes a + (i - a) mod p.
    Null ids and texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("_h"))
    d = d.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    d = d.withColumn("_a", F.expr("(_h div 10) % greatest(size(_w), 1)")).withColumn("_p", F.expr("1 + (size(_w) - _a) div (3 + (_h div 10) % 8)"))
    changed = F.expr("array_join(transform(_w, (w, i) -> if(i < _a, w, _w[int(_a + (i - _a) % _p)])), ' ')")
    return d.select("doc_id", F.when(F.expr("size(_w) > 0"), changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The result of :func:`collapse_runs` as numbers and checksums, with the run of most periods."""
    best = "aggregate(slice(runs, 2, size(runs)), runs[0], (b, x) -> if(x.length * b.period > b.length * x.period, x, b))"
    lines = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')"
    return found.withColumn("_best", F.when(F.expr("size(runs) > 0"), F.expr(best))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"), F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
