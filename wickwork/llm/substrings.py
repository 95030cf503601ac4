"""Removing repeated substrings with a run-length index.

Windows of ``length`` bytes are what may repeat. Each window has an anchor, the least hash of the ``GRAM``-byte strings in
it; neighbouring windows with one anchor form a segment. Equal windows have equal anchors, so segments meet by anchor:

1. Segments that are equal as a whole repeat in all their windows; they are found by counting, copies combined early.
2. The different segments of an anchor, one copy of each, are indexed together: a Burrows-Wheeler transform stored as
   runs, with the text position and the shared prefix length of the neighbouring suffix sampled at both ends of each run.
   Between samples the shared length falls by one a byte, so one pass over the text streams its matching statistics
   against everything else in the index; windows with a statistic of at least ``length`` are marked.
3. An index tells the repeats within itself only. So an anchor with too many different segments for one task (a passage
   inside many documents) is settled by counting, which spreads over tasks: blocks of 16 windows placed relative to the
   anchor are counted whole and by their cores; only blocks that are unlike others although their core is shared go on,
   window by window. The result is the same, and every step combines before it shuffles.

Hashes have 64 bits and are used in pairs (anchor and content) wherever equality decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import cut
from wickwork.llm.textkernel import Hashes, chunks, column_bytes, sliding_min

LENGTH = 400
GRAM = 64
#: An anchor with more different segments or bytes than this is split.
HOT_SEGMENTS, HOT_BYTES = 2000, 1 << 22
#: Bytes indexed together.
INDEX_BYTES = 1 << 16
BLOCK = 16


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, content hash, row, start, windows and whether the anchor may occur twice, for each segment."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    windows = np.maximum(off[1:] - off[:-1] - length + 1, 0)
    if not windows.any():
        return none
    h, width = Hashes(data), length - gram + 1
    g = h.grams(gram)
    low = sliding_min(g, width)
    valid = np.zeros(len(low) + 1, np.int32)
    np.add.at(valid, off[:-1][windows > 0], 1)
    np.add.at(valid, (off[:-1] + windows)[windows > 0], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    firsts = off[:-1][windows > 0]
    new[firsts] = True
    start = np.flatnonzero(new)
    # A segment ends where the next begins or where its row has no more windows.
    row = np.searchsorted(off, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(low)), off[row] + windows[row])
    value = low[start]
    # Positions that are the least of some window, twice the same value nearby: the segment may repeat in itself.
    top = ~sliding_min(~np.concatenate([np.zeros(width - 1, low.dtype), low, np.zeros(width - 1, low.dtype)]), width)
    least = np.flatnonzero(g == top[: len(g)])
    twin = least[1:][(g[least[1:]] == g[least[:-1]]) & (least[1:] - least[:-1] < width)]
    several = (end - start > width) | np.isin(value, np.unique(g[twin]))
    content = h.of(start, end - 1 + length)
    return value.view(np.int64), content.view(np.int64), row, start - off[row], end - start, several


class RunIndex:
    """The run-length Burrows-Wheeler transform of several byte strings with samples at the ends of its runs."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n_texts = len(off) - 1
        # Symbol 0 ends each text; it sorts first, by the text's number.
        ends = off[1:] + np.arange(n_texts)
        x = np.zeros(len(data) + n_texts, np.int64)
        body = np.ones(len(x), bool)
        body[ends] = False
        x[body] = data.astype(np.int64) + 1
        self.n, self.body = len(x), body
        place = np.arange(self.n)
        stop = np.repeat(ends, np.diff(off) + 1)
        self.stop = stop
        order = self._suffixes(x, place, stop)
        before = np.where(order > 0, x[order - 1], 0)
        head = np.ones(self.n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.runs = int(head.sum())
        tail = np.append(head[1:], True)
        # Samples: at heads against the suffix above, at tails against the one below.
        self.hashes = Hashes(np.where(body, np.maximum(x - 1, 0), 0).astype(np.uint8))
        at = np.flatnonzero(head)[1:]
        self.up = (order[at], self._shared(order[at - 1], order[at]))
        at = np.flatnonzero(tail)[:-1]
        self.down = (order[at], self._shared(order[at], order[at + 1]))

    @staticmethod
    def _suffixes(x: np.ndarray, place: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n, h = len(x), 7
        key = np.zeros(n, np.int64)
        for t in range(h):
            inside = place + t <= stop
            key = (key << 9) | np.where(inside, x[np.minimum(place + t, n - 1)], 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        longest = int((stop - place).max()) + 1 if n else 0
        size = np.bincount(rank)
        rank = (np.cumsum(size) - size)[rank]
        while h < longest:
            # Only suffixes that still share their rank are told apart further.
            tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
            if not len(tied):
                break
            ahead = place[tied] + h
            second = np.where(ahead <= stop[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
            key = rank[tied] * (n + 2) + second
            by = np.argsort(key)
            ks = key[by]
            new = np.append(True, ks[1:] != ks[:-1])
            group_new = np.append(True, rank[tied][by][1:] != rank[tied][by][:-1])
            index = np.arange(len(by))
            offset = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(group_new, index, 0))
            rank[tied[by]] += offset
            h *= 2
        return np.argsort(rank * n + place)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix length of suffix pairs, by bisection over hashes; it never passes a text's end."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.stop[a] - a, self.stop[b] - b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes.of(a, a + mid) == self.hashes.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def statistics(self) -> np.ndarray:
        """For each byte of the texts, the longest match that starts there with any other position of the index."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for at, shared in (self.up, self.down):
            reach = np.zeros(self.n, np.int64)
            np.maximum.at(reach, at, at + shared)
            best = np.maximum(best, np.maximum.accumulate(reach) - place)
        return best[self.body]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _mark_by_index(length: int):
    """Rows (a, k, st, nw, seg) sorted by a -> marked byte spans (k, st, en)."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def index(rows):
            texts = [r[4] for r in rows]
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            long = RunIndex(np.frombuffer(b"".join(texts), np.uint8), off).statistics() >= length
            k, st, en = [], [], []
            for i, r in enumerate(rows):
                for u, v in zip(*_spans(long[off[i] : off[i] + r[3]]), strict=True):
                    k.append(r[1])
                    st.append(r[2] + int(u))
                    en.append(r[2] + int(v) - 1 + length)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(st, pa.int64()), pa.array(en, pa.int64())], ["k", "st", "en"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > INDEX_BYTES and r[0] != held[-1][0]:
                    yield index(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield index(held)

    return run


def _blocks(length: int, gram: int):
    """Rows (a, k, st, nw, n, seg) -> blocks (a, b, core, whole, k, st, nw, n, each)."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for a, k, st, nw, n, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(seg, np.uint8)
                h = Hashes(data)
                x = np.flatnonzero(h.grams(gram).view(np.int64) == a)
                t = np.arange(nw)
                first = x[np.searchsorted(x, t)]
                block = (first - t) // BLOCK
                cuts = np.append(np.flatnonzero(np.append(True, (np.diff(first) != 0) | (np.diff(block) != 0))), nw)
                s, e = cuts[:-1], cuts[1:]
                core = first[s] - block[s] * BLOCK
                core_hash = h.of(core, core + length - BLOCK + 1).view(np.int64)
                whole = h.of(s, e - 1 + length).view(np.int64)
                each = h.of(t, t + length).view(np.int64)
                for i in range(len(s)):
                    row = (a, block[s[i]], core_hash[i], whole[i], k, st + s[i], e[i] - s[i], n, each[s[i] : e[i]])
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["a", "b", "core", "whole", "k", "st", "nw", "n", "each"])

    return run


def _mark_hot(segs: DataFrame, length: int, gram: int) -> DataFrame:
    blocks = cut(segs.select("a", "k", "st", "nw", "n", "seg").mapInArrow(
        _blocks(length, gram), "a long, b long, core long, whole long, k long, st long, nw long, n long, each array<long>"))
    wholes = cut(blocks.groupBy("a", "b", "whole").agg(F.sum("n").alias("c")))
    cores = cut(blocks.groupBy("a", "b", "core").agg(F.count("*").alias("c")).filter("c > 1").drop("c"))
    equal = (blocks.select("a", "b", "whole", "k", "st", "nw").join(wholes.filter("c > 1").drop("c"), ["a", "b", "whole"])
             .select("k", "st", (F.col("st") + F.col("nw") - 1 + length).alias("en")))
    # One copy of each block whose core is shared, window by window.
    open_ = blocks.join(cores, ["a", "b", "core"]).groupBy("a", "b", "whole").agg(
        F.sum("n").alias("c"), F.min(F.struct("k", "st", "each")).alias("one"))
    single = cut(open_.select("a", "c", "one.k", "one.st", F.posexplode("one.each").alias("i", "w")))
    again = cut(single.groupBy("a", "w").agg(F.sum("c").alias("times")).filter("times > 1").drop("times"))
    alone = (single.filter("c = 1").join(again, ["a", "w"])
             .select("k", (F.col("st") + F.col("i")).alias("st"), (F.col("st") + F.col("i") + length).alias("en")))
    return equal.unionByName(alone)


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte spans (k, st, en) of ``keyed`` (k, text) that a repeated window covers; spans may touch or overlap."""

    def find(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for lo, _, data, off in chunks(batch.column(1)):
                a, s, row, st, nw, several = segments(data, off, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(s), pa.array(keys[lo + row]), pa.array(st.astype(np.int32)), pa.array(nw.astype(np.int32)), pa.array(several)],
                    ["a", "s", "k", "st", "nw", "several"])

    found = cut(keyed.filter(F.octet_length("text") >= length).mapInArrow(find, "a long, s long, k long, st int, nw int, several boolean"))
    contents = cut(found.groupBy("a", "s").agg(F.count("*").alias("n"), F.max("several").alias("several"), F.min(F.struct("k", "st", "nw")).alias("one")))
    equal = (found.select("a", "s", "k", "st", "nw").join(contents.filter("n > 1").select("a", "s"), ["a", "s"])
             .select("k", F.col("st").cast("long").alias("st"), (F.col("st") + F.col("nw") - 1 + length).cast("long").alias("en")))
    anchors = cut(contents.groupBy("a").agg(F.count("*").alias("segments"), F.sum(F.col("one.nw") + length - 1).alias("bytes"),
                                            F.bool_or((F.col("n") == 1) & F.col("several")).alias("several"))
                  .filter("segments > 1 or several")
                  .select("a", ((F.col("segments") > HOT_SEGMENTS) | (F.col("bytes") > HOT_BYTES)).alias("hot")))
    wanted = contents.join(anchors, "a").select("a", "hot", "n", "one.k", "one.st", "one.nw")
    by_row = wanted.groupBy("k").agg(F.collect_list(F.struct("a", "hot", "n", "st", "nw")).alias("parts"))

    def fetch(batches):
        fetched: set[int] = set()  # equal rows have one key, and one of them serves
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, off = column_bytes(batch.column(1))
            out = [[] for _ in range(7)]
            for i, key in enumerate(keys):
                if key in fetched:
                    continue
                fetched.add(key)
                for p in parts[i]:
                    at = off[i] + p["st"]
                    row = (p["a"], p["hot"], p["n"], key, p["st"], p["nw"], data[at : at + p["nw"] - 1 + length].tobytes())
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["a", "hot", "n", "k", "st", "nw", "seg"])

    # Rows with equal keys are equal texts; their segments count twice, so any one row serves.
    texts = keyed.join(by_row, "k").select("k", "text", "parts")
    segs = cut(texts.mapInArrow(fetch, "a long, hot boolean, n long, k long, st long, nw long, seg binary"))
    cool = segs.filter("not hot").select("a", "k", "st", "nw", "seg")
    marked = cool.repartition("a").sortWithinPartitions("a").mapInArrow(_mark_by_index(length), "k long, st long, en long")
    out = equal.unionByName(marked)
    if not segs.filter("hot").isEmpty():
        out = out.unionByName(_mark_hot(segs.filter("hot"), length, gram))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left as
    text; a character that is cut through becomes U+FFFD there).

    A byte goes if a string of ``length`` bytes over it starts anywhere else in the input too, in the same document or
    another; a first occurrence is not kept. Null text is empty. Equal rows repeat each other. Other columns are dropped.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select("k", "text"), length, gram)
    by_row = spans.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("st", "en"))).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def strike(batches):
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            spans = batch.column(2)
            out = [[] for _ in range(5)]
            bounds = np.asarray(spans.offsets)
            flat = spans.values
            sts, ens = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            lost = spans.is_null().to_pylist()
            for i in range(len(batch)):
                text = data[off[i] : off[i + 1]]
                removed = n_spans = 0
                if lost[i] or bounds[i] == bounds[i + 1]:
                    kept = text.tobytes()
                else:
                    lo, hi = bounds[i], bounds[i + 1]
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, sts[lo:hi], 1)
                    np.add.at(depth, ens[lo:hi], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    kept, removed, n_spans = text[~gone].tobytes(), int(gone.sum()), len(_spans(gone)[0])
                for c, v in zip(out, (len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([x.decode("utf-8", "replace") for x in out[4]], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    joined = keyed.join(by_row, "k", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strike, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else ""))
