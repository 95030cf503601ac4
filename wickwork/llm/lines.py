"""Fuzzy line deduplication by MinHash.

Lines that are equal are one node. A node's signature holds the least permuted hashes of its character shingles; bands of
the signature put nodes into buckets. Within a bucket nodes are compared by a sketch of the whole signature (a byte of each
of its numbers), pairs that pass are verified by the exact Jaccard similarity of the shingle sets, and distributed union-find
joins them. One line of each component stays.

Band keys outnumber all else, so they travel as packed arrays: a task combines the keys it has seen, and of a bucket that it
fills itself only one node meets the other tasks' keys. All later tables hold only nodes that share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.components import components
from wickwork.llm.jaccard import agreeing, bucket_links
from wickwork.llm.shared import cut, likely, split_join
from wickwork.llm.textkernel import BLANK, LOWER, Hashes, ascending, chunks, column_bytes, mix

#: Characters (A-Z lower-cased) in a shingle. Lines with fewer have none: they are compared by equality or left alone.
GRAM = 8
PERCENT = 80
#: A pair at the threshold shares no bucket with probability (1 - 0.8**4)**16 = 0.0002, one at 0.9 with 4e-8.
ROWS, BANDS = 4, 16
#: Nodes that a task remembers having sent bands of, and keys that it combines before it sends them.
SEEN, HELD = 200_000, 400_000
#: Bytes of text whose bands one task gathers.
TEXT_PART = 1 << 23
#: Copies of a repeated row that one task writes.
COPIES = 1000

_rng = np.random.default_rng(5)
_MUL = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and number in its text of each line, line feeds excluded."""
    feed = np.flatnonzero(data == 10)
    # A line starts at each row's start and after each feed inside a row.
    start = np.concatenate([off[:-1], feed + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feed, "right") - 1])
    by = np.lexsort((start, row))
    start, row = start[by], row[by]
    end = np.append(start[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = off[row[last] + 1]
    return start, end, row, np.arange(len(row)) - np.searchsorted(row, row)


class Lines:
    """The lines of a run of texts: their places, hashes, and characters."""

    def __init__(self, data: np.ndarray, off: np.ndarray, short: bool):
        low = LOWER[data]
        self.hashes = Hashes(low)
        #: Where characters start, and the end.
        self.chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        start, end, row, number = split(data, off)
        first, last = np.searchsorted(self.chars, start), np.searchsorted(self.chars, end)
        on = self.long = last - first >= GRAM
        if short:
            # Only lines under GRAM characters may be blank.
            few = np.flatnonzero(~on)
            n = end[few] - start[few]
            at = np.repeat(start[few] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            on = on.copy()
            on[np.repeat(few, n)[~BLANK[data[at]]]] = True
        self.start, self.end, self.row, self.number, self.first, self.last, self.long = (x[on] for x in (start, end, row, number, first, last, self.long))
        self.node = self.hashes.of(self.start, self.end)

    def signatures(self, at: np.ndarray) -> np.ndarray:
        """The least permuted hashes (number, line) of the shingles of the lines ``at``, which have some."""
        first, n = self.first[at], self.last[at] - self.first[at] - GRAM + 1
        bounds = np.cumsum(n) - n
        i = np.repeat(first - bounds, n) + np.arange(int(n.sum()))
        a, b = self.chars[i], self.chars[i + GRAM]
        g = (mix((self.hashes.sums[b] - self.hashes.sums[a]) * self.hashes.down[a]) >> np.uint64(32)).astype(np.uint32)
        out, each = np.empty((ROWS * BANDS, len(at)), np.uint32), np.empty_like(g)
        for p in range(ROWS * BANDS):
            np.multiply(g, _MUL[p], out=each)
            np.add(each, _ADD[p], out=each)
            np.minimum.reduceat(each, bounds, out=out[p])
        return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """The bucket (band, line) of each band; the lowest bit is free."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], signatures.shape[1], 1)
    for band in range(BANDS):
        for p in range(band * ROWS, band * ROWS + ROWS):
            key[band] = mix(key[band] * np.uint64(0x9E3779B97F4A7C15) + signatures[p])
    return key & ~np.uint64(1)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """A byte of each number (line, number)."""
    return np.ascontiguousarray(signatures.T.astype(np.uint8))


def _found(short: bool):
    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column(1))
            for lo, _, data, off in chunks(batch.column(2), 1 << 18):
                x = Lines(data, off, short)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + x.row)), pa.array(keys[lo + x.row]), pa.array(x.number.astype(np.int32)), pa.array((x.start - off[x.row]).astype(np.int32)),
                     pa.array((x.end - x.start).astype(np.int32)), pa.array(x.node.view(np.int64))],
                    ["doc_id", "k", "number", "st", "n", "s"])

    return run


def _grouped(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, node) in order, whether each is the first of its key, and the number of nodes of its key."""
    by = np.argsort(key)
    key, node = key[by], node[by]
    # Few keys are equal: only their nodes are put in order.
    tie = np.append(False, key[1:] == key[:-1])
    tie[:-1] |= tie[1:]
    node[tie] = node[tie][np.lexsort((node[tie], key[tie]))]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node = key[new], node[new]
    first = np.append(True, key[1:] != key[:-1])
    return key, node, first, np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]


def _packed(parts: int):
    """Texts -> rows (part, more, pairs): arrays of (bucket, node), the bucket's lowest bit telling of more nodes in the task,
    and with ``more`` those other nodes, in any part."""

    def flush(held):
        key, node, first, n = _grouped(np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held]))
        rest = np.stack([key[~first], node[~first]], 1)
        key, node = key[first] | (n[first] > 1).astype(np.uint64), node[first]
        part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        pairs, at = np.stack([key[by], node[by]], 1), np.searchsorted(part[by], np.arange(parts + 1))
        out = [(p, False, pairs[a:b].tobytes()) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        out += [(int(rest[a, 0] % np.uint64(parts)), True, rest[a : a + 4096].tobytes()) for a in range(0, len(rest), 4096)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["part", "more", "pairs"])

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0), 1 << 18):
                x = Lines(data, off, False)
                fresh = []
                for i, s in enumerate(x.node.tolist()):
                    if s not in seen:
                        seen.add(s)
                        fresh.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if fresh:
                    at = np.array(fresh)
                    key = bands(x.signatures(at))
                    held.append((key.ravel(), np.tile(x.node[at], BANDS)))
                    size += key.size
                if size > HELD:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _met(batches):
    """Rows (more, pairs), all of a part in one partition -> (bucket, s) of the buckets with several nodes."""
    held = []
    for batch in batches:
        for more, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(pairs, np.uint64).reshape(-1, 2)
            if more:
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].view(np.int64)), pa.array(x[:, 1].view(np.int64))], ["bucket", "s"])
            else:
                held.append(x)
    if held:
        x = np.concatenate(held)
        held.clear()
        more = x[:, 0] & np.uint64(1) == 1
        key, node, _, n = _grouped(x[:, 0] & ~np.uint64(1), x[:, 1])
        on = (n > 1) | np.isin(key, ascending(x[more, 0] & ~np.uint64(1)))
        yield pa.RecordBatch.from_arrays([pa.array(key[on].view(np.int64)), pa.array(node[on].view(np.int64))], ["bucket", "s"])


def _texts(batches):
    """Rows (k, text, wanted) -> (s, items, sketch): the wanted lines in lower case with their sketches, once for equal rows."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        batch = batch.take(pa.array(fresh, pa.int64()))
        for lo, hi, data, off in chunks(batch.column(1), 1 << 18):
            x = Lines(data, off, False)
            want = {(i, w["st"]) for i, wanted in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()) for w in wanted}
            at = np.array([i for i, place in enumerate(zip(x.row.tolist(), (x.start - off[x.row]).tolist(), strict=True)) if place in want], np.int64)
            if not len(at):
                continue
            low, sk = LOWER[data], sketches(x.signatures(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.node[at].view(np.int64)), pa.array([low[a:b].tobytes() for a, b in zip(x.start[at], x.end[at], strict=True)], pa.binary()),
                 pa.array([r.tobytes() for r in sk], pa.binary())], ["s", "items", "sketch"])


def _shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles of all lines, and their number in each."""
    data, off = column_bytes(column)
    data, off = data[off[0] : off[-1]], off - off[0]
    h, chars = Hashes(data), np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars, off)
    n = np.maximum(np.diff(first) - GRAM + 1, 0)
    i = np.repeat(first[:-1] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    a, b = chars[i], chars[i + GRAM]
    return mix((h.sums[b] - h.sums[a]) * h.down[a]), n


def _links(keyed: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between nodes that join all nodes which link, directly or over others."""
    size = found.agg(F.sum("n")).first()[0] or 0
    parts = max(8, -(-size // TEXT_PART))
    packed = keyed.select("text").mapInArrow(_packed(parts), "part int, more boolean, pairs binary")
    met = packed.repartition(parts, "part").select("more", "pairs").mapInArrow(_met, "bucket long, s long")
    members = cut(met.distinct())
    wanted = cut(members.select("s").distinct())
    places = likely(found.select("k", "st", "s"), "s", wanted).filter("_likely").groupBy("s").agg(F.first("k").alias("k"), F.first("st").alias("st"))
    by_row = cut(places.join(wanted, "s").groupBy("k").agg(F.collect_list(F.struct("s", "st")).alias("wanted")))
    texts = likely(keyed.select("k", "text"), "k", by_row.select("k")).filter("_likely")
    items = cut(texts.join(by_row, "k").select("k", "text", "wanted").mapInArrow(_texts, "s long, items binary, sketch binary"))
    return bucket_links(members, items, percent, agreeing(ROWS * BANDS, percent), _shingles)


def dedup_lines(docs: DataFrame, percent: int = PERCENT, short: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any others) with each line gone that a kept line repeats or nearly repeats.

    Of the lines of a component the first stays, by doc_id (null first), then by a hash of the row, then by its place.
    Every row stays, its text perhaps empty; a null text stays null; ``n_chars``, if there, is counted anew. Lines under
    ``GRAM`` characters that are not blank lose their repeats (A-Z lower-cased) if ``short``, and stay otherwise. Of rows that
    are equal in doc_id and text one keeps its lines, that of the least hash of all columns; the others lose all that count.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text").filter(F.octet_length("text") >= (1 if short else GRAM))
    found = cut(keyed.mapInArrow(_found(short), f"doc_id {kind}, k long, number int, st int, n int, s long"))
    classes = components(_links(keyed, found, percent))
    counts = found.groupBy("s").agg(F.count("*").alias("c"))
    touched = counts.join(classes.withColumnRenamed("node", "s"), "s", "left").filter("c > 1 or component is not null")
    touched = cut(touched.select("s", "c", F.coalesce("component", "s").alias("root")))
    lines = likely(found.select("doc_id", "k", "number", "s"), "s", touched.select("s")).filter("_likely").drop("_likely")
    lines = cut(split_join(lines, touched, "s", "c").select("root", "doc_id", "k", "number"))
    keep = cut(lines.groupBy("root").agg(F.min(F.struct("doc_id", "k", "number")).alias("keep"), F.count("*").alias("c")).select("root", "c", F.col("keep.k").alias("kept_k"), F.col("keep.number").alias("kept_number")))
    other = (F.col("k") != F.col("kept_k")) | (F.col("number") != F.col("kept_number"))
    # A row that occurs m times has each of its lines m times.
    cuts = split_join(lines, keep, "root", "c").groupBy("k").agg(F.collect_set(F.when(other, F.col("number"))).alias("_gone"), F.collect_set("number").alias("_all"), F.count("*").alias("_n"))
    gone = cut(cuts.select(F.col("k").alias("_k"), "_gone", "_all", (F.col("_n") > F.size("_all")).alias("_again")).filter("_again or size(_gone) > 0"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("doc_id", "text").alias("_k"))
    marked = likely(whole, "_k", gone.select("_k"))
    again = gone.filter("_again").select("_k")
    # Lines are split below the join, so that a text's lines are made once and then taken by their numbers.
    split_ = lambda d: d.withColumn("_lines", F.split("doc.text", "\n", -1)).withColumn("doc", F.col("doc").dropFields("text"))
    single = marked.filter("_likely").drop("_likely")
    if again.isEmpty():
        out = _without(split_(single).join(gone.select("_k", "_gone"), "_k", "left"), docs)
    else:
        # Rows that may be repeated are counted before any join; no task gets all that are equal, neither here nor below.
        single = likely(single, "_k", again)
        rows = single.filter("_likely").groupBy("_k", F.xxhash64(F.to_json("doc")).alias("_row")).agg(F.first("doc").alias("doc"), F.count("*").alias("_n"))
        rows = cut(rows)
        least = cut(rows.groupBy("_k").agg(F.min("_row").alias("_least"), F.count("*").alias("_c")).join(gone, "_k", "left"))
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}")))
        each = split_join(rows, least, "_k", "_c").withColumn("_part", part).repartition("_k", "_row", "_part")
        each = each.withColumn("_copy", F.explode(F.expr(f"sequence(_part * {COPIES}, least(_n, (_part + 1) * {COPIES}) - 1)")))
        keeps = ~F.coalesce("_again", F.lit(False)) | (F.col("_row") == F.col("_least")) & (F.col("_copy") == 0)
        copies = _without(split_(each.withColumn("_gone", F.when(keeps, F.col("_gone")).otherwise(F.col("_all")))), docs)
        out = _without(split_(single.filter("not _likely")).join(gone.select("_k", "_gone"), "_k", "left"), docs).unionByName(copies)
    return marked.filter("not _likely").select("doc.*").unionByName(out)


def _without(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows (doc, _lines, _gone), the text being the lines whose numbers are not in _gone."""
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_gone", F.array().cast("array<int>"))), lambda i: F.get("_lines", i))
    out = rows.withColumn("text", F.array_join(left, "\n")).select("doc.*", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
