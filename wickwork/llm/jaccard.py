"""Near-duplicate documents by word shingles: a Jaccard join over signature trees.

1. Documents with equal shingle sets are one node; all that follows works on nodes.
2. Nodes meet in buckets of ``ROWS`` minhashes, ``BANDS`` of them: a pair at the threshold of 0.85 shares no bucket with
   probability (1 - 0.85**4)**32 < 6e-11, a pair that shares a third of its shingles meets in few.
3. The buckets of the first ``TREE_BANDS`` bands, up to ``BLOCK_NODES`` nodes each, are searched by signature trees over the
   sets: nodes of a tree hold the union of the token bitmaps below them, the range of set sizes and the largest number
   of bitmap collisions. Both sides are walked together; a pair of tree nodes is dropped if its sizes, or the bits it has
   in common, bound the overlap below what the threshold asks, or if all below is already joined. Pairs of leaves that
   remain are verified on the sets. A pair at the threshold meets here with probability 1 - (1 - 0.85**4)**4 = 0.95.
4. What is still apart then, in any band and in buckets of any size, is compared with the least node of each of its
   buckets, by sketches (a byte of each minhash), and where those agree by the sets. It joins groups of copies that are
   too large for one tree in one round.
5. Of the buckets that still hold several components, a tree over the sketches (their 128 bytes are the tokens) finds the
   nodes that are alike across components, and a tree over the sets links them. A bucket with more than ``BLOCK_NODES``
   nodes is dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.components import Forest, components
from wickwork.llm.shared import WORD, cut, likely, split_join
from wickwork.llm.textkernel import LOWER, Hashes, ascending, chunks, column_bytes, mix, words

WIDTH = 4
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 85
ROWS, BANDS = 4, 32
BLOCK_NODES = 1024
#: Bands whose buckets are searched by trees before anything else is compared.
TREE_BANDS = 4
LEAF = 8
#: Up to so many nodes are all compared at once, which takes less time than a tree; their bitmaps take 32 MB at most.
FEW_NODES = 128
#: The longest bitmap. Bits that several tokens of a set share are counted, so a short one only prunes less.
MAP_BITS = 1 << 16

_rng = np.random.default_rng(77)
_MUL = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty one none."""
    start, end, row = words(data, off)
    w = Hashes(LOWER[data]).of(start, end)
    bounds = np.searchsorted(row, np.arange(len(off)))
    n = max(0, len(w) - width + 1)
    s = np.zeros(n, np.uint64)
    for t in range(width):
        s = (s ^ w[t : t + n]) * _STEP[t % 4]
        s ^= s >> np.uint64(29)
    s = mix(s)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(ascending(s[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for t in range(a, b):
                h = mix(h * _STEP[0] + w[t : t + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The least permuted hashes of a set; the sketch is a byte of each."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MUL), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 4096):
            least = np.minimum(least, (low[at : at + 4096, None] * _MUL + _ADD).min(0))
    return least


def agreeing(n: int, percent: int) -> int:
    """So many bytes of two sketches of ``n`` agree, unless a pair at the threshold lies 4.5 deviations below what is expected
    (4e-6 of such pairs)."""
    p = percent / 100
    return int(n * p - 4.5 * (n * p * (1 - p)) ** 0.5)


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key a band from the least of ``ROWS`` permuted hashes each."""
    least = signature(s)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in least.reshape(BANDS, ROWS).T.astype(np.uint64):
            key = mix(key * _STEP[1] + r)
    return key.view(np.int64)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


class SignatureTree:
    """Levels of bitmaps over sets ordered by size; level 0 is the sets themselves."""

    def __init__(self, sets: list[np.ndarray], group: np.ndarray, bits: int | None = None):
        size = np.array([len(s) for s in sets])
        bits = bits or max(64, min(MAP_BITS, 1 << int(4 * size.max()).bit_length()))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            b = s % np.uint64(bits)
            np.bitwise_or.at(maps[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        lost = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, lost, group, group)]
        while len(maps := self.levels[-1][0]) > 1:
            _, low, high, lost, first, last = self.levels[-1]
            at = np.arange(0, len(maps), LEAF)
            self.levels.append((np.bitwise_or.reduceat(maps, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(lost, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def pairs(self, percent: int = PERCENT):
        """Arrays (i, j) of sets that may link, i < j."""

        def need(low_i, high_i, low_j, high_j):
            return -(-percent * np.maximum(low_i, low_j) // 100), (100 * high_i >= percent * low_j) & (100 * high_j >= percent * low_i)

        yield from self._walk(need)

    def candidates(self, common: int):
        """Arrays (i, j) of sets below inner nodes that may have ``common`` members in common, i < j."""
        yield from self._walk(lambda low_i, high_i, low_j, high_j: (np.full(len(low_i), common), np.minimum(high_i, high_j) >= common), False)

    def _walk(self, bound, leaves: bool = True):
        i = j = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, i, j)]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 20_000:
                stack += [(level, i[:20_000], j[:20_000]), (level, i[20_000:], j[20_000:])]
                continue
            maps, low, high, lost, first, last = self.levels[level]
            joined = (first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j])
            need, fits = bound(low[i], high[i], low[j], high[j])
            keep = ~joined & fits
            i, j, need = i[keep], j[keep], need[keep]
            if level == 0 and not leaves:
                on = i < j
                yield i[on], j[on]
                continue
            common = np.empty(len(i), np.int64)
            step = max(1, (1 << 21) // maps.shape[1])
            for at in range(0, len(i), step):
                common[at : at + step] = np.bitwise_count(maps[i[at : at + step]] & maps[j[at : at + step]]).sum(1, dtype=np.int64)
            keep = common + np.minimum(lost[i], lost[j]) >= need
            i, j = i[keep], j[keep]
            if level == 0:
                on = i < j
                yield i[on], j[on]
                continue
            n = len(self.levels[level - 1][0])
            ci = (i[:, None, None] * LEAF + np.arange(LEAF)[None, :, None] + np.zeros(LEAF, np.int64)).ravel()
            cj = (j[:, None, None] * LEAF + np.arange(LEAF)[None, None, :] + np.zeros((LEAF, 1), np.int64)).ravel()
            on = (ci < n) & (cj < n) & (ci <= cj)
            if on.any():
                stack.append((level - 1, ci[on], cj[on]))


def may_link(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The (i, j) of all sets that may link, i < j: one product of their bitmaps bounds what all pairs have in common."""
    size = np.array([len(s) for s in sets])
    bits = max(64, min(MAP_BITS, 1 << int(4 * size.max()).bit_length()))
    maps = np.zeros((len(sets), bits), np.float32)  # counts below 2**24 are exact
    maps[np.repeat(np.arange(len(size)), size), (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = 1
    lost = size - maps.sum(1).astype(np.int64)
    most = (maps @ maps.T).astype(np.int64) + np.minimum(lost[:, None], lost)
    return np.nonzero(np.triu((100 + percent) * np.minimum(most, np.minimum(size[:, None], size)) >= percent * (size[:, None] + size), 1))


def search(nodes: list[int], group: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Verified links that join different groups: enough of them to join all that link."""
    by = sorted(range(len(sets)), key=lambda t: (len(sets[t]), group[t]))
    if len(by) > FEW_NODES:
        pairs = SignatureTree([sets[t] for t in by], group[by]).pairs(percent)
    else:
        pairs = [may_link([sets[t] for t in by], percent)]
    forest, found = Forest(), []
    name = group[by]
    for i, j in pairs:
        for lo in range(0, len(i), 1024):
            # What earlier links have joined is not looked at again.
            root = np.array([forest.find(g) for g in name.tolist()]) if lo == 0 or fresh else root
            fresh, a_, b_ = False, i[lo : lo + 1024], j[lo : lo + 1024]
            apart = root[a_] != root[b_]
            for a, b in zip(a_[apart].tolist(), b_[apart].tolist(), strict=True):
                ga, gb, a, b = int(name[a]), int(name[b]), by[a], by[b]
                if forest.find(ga) != forest.find(gb) and linked(sets[a], sets[b], percent):
                    fresh = forest.join(ga, gb)
                    found.append((nodes[a], nodes[b]))
    return found


#: Bits of a hash that tell tokens apart within a pair or a row of a batch; the others number the row.
_HASH = 48


def overlaps(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sizes of the sets and of their intersections, for rows of ``na`` and ``nb`` hashes (perhaps repeated) in ``a`` and ``b``."""
    row = np.arange(len(na), dtype=np.uint64) << np.uint64(_HASH)
    of = lambda x, n, side: (((np.repeat(row, n) | (x >> np.uint64(64 - _HASH))) << np.uint64(1)) | np.uint64(side))
    key = np.concatenate([of(a, na, 0), of(b, nb, 1)])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    at, side = (key >> np.uint64(_HASH + 1)).astype(np.int64), key & np.uint64(1) == 1
    both = np.zeros(len(key), bool)
    both[1:] = (key[1:] ^ key[:-1]) == 1
    return tuple(np.bincount(at[on], minlength=len(na)) for on in (~side, side, both))


def distinct(flat: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The set of the hashes of each row."""
    out = []
    for lo in range(0, len(n), 1 << 14):
        part = n[lo : lo + (1 << 14)]
        start = int(n[:lo].sum())
        row = np.arange(len(part) + 1, dtype=np.uint64) << np.uint64(_HASH)
        key = ascending(np.repeat(row[:-1], part) | (flat[start : start + int(part.sum())] >> np.uint64(64 - _HASH)))
        bounds = np.searchsorted(key, row)
        key &= np.uint64((1 << _HASH) - 1)
        out += [key[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def _describe(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                sets = shingle_sets(data, off, width)
                with np.errstate(over="ignore"):
                    s = mix(np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64) + np.uint64(1))
                    t = np.array([np.bitwise_xor.reduce(mix(x ^ _STEP[2])) if len(x) else 0 for x in sets], np.uint64)
                bands = np.concatenate([band_keys(x) if len(x) else np.zeros(BANDS, np.int64) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(s.view(np.int64)),
                     pa.array(t.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands))],
                    ["doc_id", "k", "n", "s", "t", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                sets = shingle_sets(data, off, width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([signature(x).astype(np.uint8).tobytes() for x in sets], pa.binary())],
                    ["s", "items", "sketch"])

    return run


def _alike(agree: int):
    """Rows (u, v, one, other) -> the (u, v) whose sketches agree in enough bytes."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in (2, 3))
            on = pa.array((a == b).sum(1) >= agree if len(batch) else [], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], ["u", "v"])

    return run


def across(sketches: np.ndarray, group: np.ndarray, agree: int) -> np.ndarray:
    """Which rows of ``sketches`` agree in ``agree`` bytes with one of another group, by a signature tree: a byte and its place
    are a token. The rows are laid out by group, so that an inner node holds like sketches and its bitmap stays small."""
    by = np.lexsort((*sketches.T[:4], group))
    sketches, group, on = sketches[by], group[by], np.zeros(len(by), bool)
    if len(by) <= FEW_NODES:
        pairs = [np.triu_indices(len(by), 1)]
    else:
        # Every token has a bit of its own: bits shared by chance would hide which inner nodes are unlike.
        tokens = sketches.astype(np.uint64) + np.arange(sketches.shape[1], dtype=np.uint64) * np.uint64(256)
        pairs = SignatureTree(list(tokens), group, 256 * sketches.shape[1]).candidates(agree)
    for i, j in pairs:
        new = (group[i] != group[j]) & ~(on[i] & on[j])
        i, j = i[new], j[new]
        for lo in range(0, len(i), 1 << 14):
            a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            same = (sketches[a] == sketches[b]).sum(1) >= agree
            on[a[same]] = on[b[same]] = True
    out = np.empty(len(by), bool)
    out[by] = on
    return out


def _open(agree: int):
    """Rows (bucket, i, j, s, c, pivot, sketch) sorted by the first three -> those (bucket, i, j, s, c) alike with one of another
    c; the pivot has been compared with all."""

    def kept(rows):
        rows = [r for r in rows if r[3] != r[5]]
        if rows:
            sketches = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
            on = across(sketches, np.array([r[4] for r in rows]), agree)
            rows = [r for r, x in zip(rows, on, strict=True) if x]
        return pa.RecordBatch.from_arrays([pa.array([r[t] for r in rows], pa.int64()) for t in range(5)], ["bucket", "i", "j", "s", "c"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if len(held) > 1:
                        yield kept(held)
                    held, at = [], row[:3]
                held.append(row)
        if len(held) > 1:
            yield kept(held)

    return run


def _verified(pairs: DataFrame, items: DataFrame, percent: int, decode) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are alike enough."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                a, b, both = overlaps(*decode(part.column(2)), *decode(part.column(3)))
                ok = pa.array(100 * both >= percent * (a + b - both))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["u", "v"])

    both = pairs.join(items.select(F.col("s").alias("u"), F.col("items").alias("one")), "u").join(items.select(F.col("s").alias("v"), F.col("items").alias("other")), "v")
    return both.select("u", "v", "one", "other").mapInArrow(run, "u long, v long")


def search_buckets(percent: int, decode):
    """Rows (bucket, i, j, s, c, items) sorted by the first three -> links (u, v)."""

    def run(batches):
        held, at = [], None

        def links():
            found = search([h[0] for h in held], np.array([h[1] for h in held]), [h[2] for h in held], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                keys = zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)
                for key, s, c, items in zip(keys, part.column(3).to_pylist(), part.column(4).to_pylist(), distinct(*decode(part.column(5))), strict=True):
                    if key != at:
                        if held:
                            yield links()
                        held, at = [], key
                    held.append((s, c, items))
        if held:
            yield links()

    return run


def _rooted(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as described, and those with shingles as (doc_id, k, n, root): rows that link share a root."""
    rows = cut(_described(docs, width))
    nodes = rows.filter("n > 0").groupBy("s", "t").agg(F.min("k").alias("k"), F.first("bands").alias("bands"))
    nodes = cut(nodes)

    placed = nodes.select("s", F.posexplode("bands").alias("band", "bucket"))
    several = cut(placed.groupBy("bucket").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("m")).filter("low <> high").select("bucket", "m"))
    members = cut(split_join(placed, several, "bucket", "m").select("band", "bucket", "m", "s").distinct())
    where = cut(nodes.select("k", "s").join(members.select("s").distinct(), "s"))
    texts = likely(docs.select("text", F.xxhash64("doc_id", "text").alias("k")), "k", where.select("k")).filter("_likely")
    items = texts.join(where, "k").select("s", "text").dropDuplicates(["s"]).mapInArrow(_sets(width), "s long, items binary, sketch binary")
    items = cut(items)
    trees = tree_links(members.filter((F.col("band") < TREE_BANDS) & (F.col("m") <= BLOCK_NODES)), items, percent, _sets_of)
    joined = components(trees)
    # The components of the trees' links stand for these links.
    classes = components(joined.toDF("u", "v").unionByName(bucket_links(members, items, percent, agreeing(ROWS * BANDS, percent), _sets_of, joined)))
    named = rows.filter("n > 0").select("doc_id", "k", "n", "s").join(classes.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("component", "s"))
    return rows, named.select("doc_id", "k", "n", "root")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable over links, the row's own included. A null or blank text has no
    shingles and links with nothing, not even with its like. Equal rows link. A null doc_id takes part but names no
    component unless it is alone. Other columns are dropped. Words have A-Z lower-cased and no length limit.
    """
    rows, named = _rooted(docs, width, percent)
    named = cut(named)
    smallest = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")))
    out = split_join(named.select("doc_id", "n", "root"), smallest, "root", "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that of the smallest doc_id (null last), of equal ones the least hash.

    Rows without words all stay. Columns are as they were.
    """
    _, named = _rooted(docs, width, percent)
    # A doc_id may be null or name several texts; only with the hash does it name a row and its equals.
    first = cut(named.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k")).alias("least")).select(F.col("least.k").alias("k")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("doc_id", "text").alias("k"))
    empty = ~F.coalesce("doc.text", F.lit("")).rlike(WORD)
    one = whole.filter(~empty).join(first, "k", "left_semi").groupBy("k").agg(F.first("doc").alias("doc"))
    return whole.filter(empty).select("doc.*").unionByName(one.select("doc.*"))


def _described(docs: DataFrame, width: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    return keyed.mapInArrow(_describe(width), f"doc_id {kind}, k long, n long, s long, t long, bands array<long>")


def _sets_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows and their number in each."""
    data, off = column_bytes(column)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint64), np.diff(off) // 8


def tree_links(members: DataFrame, items: DataFrame, percent: int, decode) -> DataFrame:
    """Links (u, v) that signature trees find within the buckets of ``members`` (bucket, s), each small enough for one task."""
    # Buckets with the same members are searched once.
    alike = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("h"))
    one = cut(alike.groupBy("h", "m").agg(F.min("bucket").alias("bucket")).select("bucket"))
    order = ("bucket", "i", "j")
    dealt = members.join(one, "bucket").join(items.select("s", "items"), "s").select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), "s", F.col("s").alias("c"), "items")
    return dealt.repartition("bucket").sortWithinPartitions(*order).mapInArrow(search_buckets(percent, decode), "u long, v long")


def bucket_links(members: DataFrame, items: DataFrame, percent: int, agree: int, decode, joined: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between nodes that join all nodes which share a bucket and link, directly or over others.

    ``members`` has distinct (bucket, s), ``items`` each s with its items, which ``decode`` turns into hashes and their number a row, and
    its sketch; pairs whose sketches agree in fewer than ``agree`` bytes are not verified. Both should be written tables.
    ``joined`` (node, component) are nodes that other links join already; pairs of one component are passed over.
    """
    sketch = items.select("s", "sketch")
    buckets = cut(members.groupBy("bucket").agg(F.min("s").alias("pivot"), F.count("*").alias("m")))
    # Each node against the least of its buckets.
    members = members.select("bucket", "s")
    pairs = split_join(members, buckets, "bucket", "m").filter("s <> pivot").select(F.col("s").alias("u"), F.col("pivot").alias("v")).distinct()
    if joined is not None:
        # A pivot may have many partners, so its component is joined by a split; all others are partners of few pivots.
        named = pairs.join(joined.toDF("u", "cu"), "u", "left").withColumn("cu", F.coalesce("cu", "u"))
        pivots = cut(buckets.groupBy("pivot").agg(F.sum("m").alias("c")).join(joined.toDF("pivot", "cv"), "pivot", "left").select(F.col("pivot").alias("v"), F.coalesce("cv", "pivot").alias("cv"), "c"))
        pairs = split_join(cut(named), pivots, "v", "c").filter("cu <> cv").select("u", "v")
    near = pairs.join(sketch.toDF("u", "one"), "u").join(sketch.toDF("v", "other"), "v").select("u", "v", "one", "other").mapInArrow(_alike(agree), "u long, v long")
    first = cut(_verified(near, items, percent, decode))
    classes = components(first if joined is None else first.unionByName(joined.toDF("u", "v")))
    # Buckets of three and more that are still in several components: the nodes that are alike across them.
    known = cut(split_join(members, buckets.filter("m > 2"), "bucket", "m").join(classes.withColumnRenamed("node", "s"), "s", "left")
                .select("bucket", "s", "m", "pivot", F.coalesce("component", "s").alias("c")))
    open_ = cut(known.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("m").alias("m"), F.sum(F.xxhash64("s").cast("decimal(38,0)")).alias("h")).filter("low <> high")
                # Buckets with the same members are searched once.
                .groupBy("h", "m").agg(F.min("bucket").alias("bucket")).select("bucket", "m", F.ceil(F.col("m") / BLOCK_NODES).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("s", F.lit(1)), F.col("blocks")).cast("int")
    dealt = (split_join(known.drop("m"), open_, "bucket", "m").withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", F.least("b", "o").cast("long").alias("i"), F.greatest("b", "o").cast("long").alias("j"), "s", "c", "pivot"))
    order = ("bucket", "i", "j")
    alike = cut(dealt.join(sketch, "s").select(*order, "s", "c", "pivot", "sketch").repartition(*order).sortWithinPartitions(*order).mapInArrow(_open(agree), "bucket long, i long, j long, s long, c long"))
    second = (alike.join(items.select("s", "items"), "s").select(*order, "s", "c", "items").repartition(*order).sortWithinPartitions(*order)
              .mapInArrow(search_buckets(percent, decode), "u long, v long"))
    return first.unionByName(second)
