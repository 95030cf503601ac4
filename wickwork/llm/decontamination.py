"""Benchmark decontamination with suffix arrays of the training texts.

The documents of each task are indexed in shards: a suffix array over the shard's words. Every suffix of every benchmark text
is searched in every shard by bisection, word by word: the interval of equal suffixes after ``width`` words holds all places
where the suffix's window occurs, and the depth at which it empties is the longest verbatim match. Suffixes of documents
whose first words start no benchmark suffix cannot match one and stay out of the array.

Benchmark texts are sent to all tasks in blocks of a bounded size; more than one block means one pass over the documents for
each. Long texts are cut into overlapping pieces, so that no text makes a block large. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import BLOCK_BYTES, blocks, cut
from wickwork.llm.textkernel import LOWER, MARKS, Hashes, chunks, column_bytes, mix, words

WIDTH = 10
#: Words of a piece of a benchmark text.
PIECE = 4096
#: Bytes of documents indexed together.
SHARD_BYTES = 4 << 20
#: First words by which suffixes are chosen for the array.
HEAD = 4
#: A-Z in lower case, then runs of ASCII letters, digits and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(column: str):
    return F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, words, n): pieces of ``bench`` (item_id, text) that overlap by ``width`` - 1 words; ``n`` is the item's word count."""
    w = F.regexp_extract_all(lowered("text"), F.lit(TERM), 0)
    step = PIECE - width + 1
    return (bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), w.alias("_w")).distinct()
            .filter("size(_w) > 0").select("item", F.size("_w").alias("n"), "_w", F.explode(F.expr(f"sequence(0, greatest(size(_w) - {width}, 0), {step})")).alias("at"))
            .select("item", "at", "n", F.array_join(F.slice("_w", F.col("at") + 1, PIECE), " ").alias("words")))


def _heads(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` ids at each place of ``x``; 0 where one of them is 0 or beyond the end."""
    n = len(x)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for t in range(k):
        y = np.append(x[t:], np.zeros(min(t, n), x.dtype))
        h = mix(h + y.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        whole &= y > 0
    return np.where(whole, h | np.uint64(1), np.uint64(0))


class Tests:
    """The suffixes of a block of benchmark pieces: word ids from 1, a 0 behind each piece."""

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        n_pieces = table.num_rows
        column = table.column("words").combine_chunks() if n_pieces else pa.array([], pa.string())
        data, off = column_bytes(column)
        data, off = data[off[0] : off[-1]], off - off[0]
        start, end, row = words(data, off, MARKS)
        self.vocabulary, ids = np.unique(Hashes(data).of(start, end), return_inverse=True)
        self.x = np.zeros(len(ids) + n_pieces, np.int64)
        place = np.arange(len(ids)) + row
        self.x[place] = ids + 1
        size = np.bincount(row, minlength=n_pieces)
        stop = np.cumsum(size) + np.arange(n_pieces)
        whole = np.asarray(table.column("n")).astype(np.int64) if n_pieces else np.empty(0, np.int64)
        self.items, item = np.unique(np.array(table.column("item").to_pylist(), object), return_inverse=True) if n_pieces else (np.empty(0, object), np.empty(0, np.int64))
        # A suffix counts from ``need`` shared words on: a window, or the whole of a shorter text.
        need = np.minimum(width, whole)[row]
        ok = stop[row] - place >= need
        self.at, self.need, self.item = place[ok], need[ok], item[row[ok]]
        self.deepest = int((stop[row] - place).max()) if len(place) else 0
        self.k = int(min(HEAD, self.need.min())) if len(self.need) else 1
        self.heads = _heads(self.x, self.k)[self.at]
        self.known = np.unique(self.heads)
        self.x = np.append(self.x, np.zeros(self.deepest + 64, np.int64))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word of a document, 0 if no benchmark text holds it."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(x: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in the order of the first ``depth`` words behind them; ``x`` has zeros behind its end."""
    bits = max(int(x.max()).bit_length(), 1) if len(x) else 1
    step = max(1, 62 // bits)
    order, slots, group = at.copy(), np.arange(len(at)), np.zeros(len(at), np.int64)
    for done in range(0, depth, step):
        key = np.zeros(len(slots), np.int64)
        for t in range(step):
            key = (key << bits) | x[np.minimum(order[slots] + done + t, len(x) - 1)]
        by = np.lexsort((key, group))
        order[slots] = order[slots][by]
        key, group = key[by], group[by]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        tied = ~(new & np.append(new[1:], True))
        group = np.maximum.accumulate(np.where(new, slots, 0))[tied]
        slots = slots[tied]
        if not len(slots):
            break
    return order


def _bound(x, order, depth, lo, hi, word, right):
    """In the intervals [lo, hi), the first place whose word at ``depth`` is not less than (``right``: greater than) ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        seen = x[order[np.minimum(mid, len(order) - 1)] + depth]
        up = open_ & ((seen <= word) if right else (seen < word))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def search_shard(tests: Tests, x: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All matches of ``tests`` in a shard of word ids ``x`` (0: unknown, or between documents) of ``rows`` documents.

    Hit words (a flag for each place), the (document, item) pairs with an occurring window, and each document's longest match.
    """
    hit, longest = np.zeros(len(x) + 1, np.int32), np.zeros(rows, np.int64)
    none = np.empty(0, np.int64)
    heads = _heads(x, tests.k)
    at = np.flatnonzero((heads > 0) & np.isin(heads, tests.known)) if len(tests.at) else none
    if not len(at):
        return hit[:-1] > 0, none, none, longest
    x = np.append(x, np.zeros(tests.deepest + 64, np.int64))
    order = suffix_array(x, at, tests.deepest)
    alive = np.flatnonzero(np.isin(tests.heads, heads[at]))
    lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(order))
    found_row, found_item = [none], [none]
    depth = 0
    while len(alive):
        word = tests.x[tests.at[alive] + depth]
        # A suffix that ends here matched as a whole.
        low = np.where(word > 0, _bound(x, order, depth, lo, hi, word, False), hi)
        high = np.where(word > 0, _bound(x, order, depth, low, hi, word, True), hi)
        on = low < high
        alive, lo, hi = alive[on], low[on], high[on]
        depth += 1
        whole = tests.need[alive] == depth
        if whole.any():
            # Each different interval of a depth holds places of its own; an item asks for it once.
            asked = np.unique(np.stack([lo[whole], hi[whole], tests.item[alive[whole]]], 1), axis=0)
            place, which = _members(order, asked[:, 0], asked[:, 1])
            pair = np.unique(row[place] * len(tests.items) + asked[which, 2])
            found_row.append(pair // len(tests.items))
            found_item.append(pair % len(tests.items))
            np.add.at(hit, place, 1)
            np.add.at(hit, place + depth, -1)
        # Longest matches: the places of each different interval, of which there are fewer at each depth.
        deep = tests.need[alive] <= depth
        if deep.any():
            spans = np.unique(np.stack([lo[deep], hi[deep]], 1), axis=0)
            longest[row[_members(order, spans[:, 0], spans[:, 1])[0]]] = depth
    return np.cumsum(hit[:-1]) > 0, np.concatenate(found_row), np.concatenate(found_item), longest


def _members(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the intervals [lo, hi), and which interval each is of."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return order[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[which]], which


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _pass(tests, kind: str, width: int):
    """Rows (doc_id, text, k[, n_words, spans, items, longest]) with what ``tests`` find added."""

    def run(batches):
        known = tests.value
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1), SHARD_BYTES):
                start, end, row = words(data, off, MARKS)
                # Hashes of words in lower case, ids with a 0 between documents.
                ids = known.ids(Hashes(LOWER[data]).of(start, end))
                place = np.arange(len(ids)) + row
                x, at_row = np.zeros(len(ids) + hi - lo, np.int64), np.zeros(len(ids) + hi - lo, np.int64)
                x[place], at_row[place] = ids, row
                hit, rows, items, longest = search_shard(known, x, at_row, hi - lo)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                s, e = edge[::2], edge[1::2]
                in_row = at_row[s]
                spans: list[list] = [[] for _ in range(hi - lo)]
                for r, u, v in zip(in_row.tolist(), (s - first[in_row] - in_row).tolist(), (e - s).tolist(), strict=True):
                    spans[r].append({"start": u, "length": v})
                names: list[list] = [[] for _ in range(hi - lo)]
                for r, i in zip(rows.tolist(), items.tolist(), strict=True):
                    names[r].append(known.items[i])
                longest = longest.tolist()
                if batch.num_columns > 3:  # what earlier blocks found
                    for i, (old, had, most) in enumerate(zip(*(batch.column(c)[lo:hi].to_pylist() for c in (4, 5, 6)), strict=True)):
                        spans[i], names[i], longest[i] = _merged(old + spans[i]), sorted(set(had + names[i])), max(most, longest[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], batch.column(2)[lo:hi], pa.array(np.diff(first), pa.int64()), pa.array(spans, _SPANS),
                     pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64())], ["doc_id", "text", "k", "n_words", "spans", "items", "longest"])

    return run, f"doc_id {kind}, text string, k long, n_words long, spans array<struct<start:long,length:long>>, items array<string>, longest long"


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: x["start"]):
        if out and x["start"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], x["start"] + x["length"] - out[-1]["start"])
        else:
            out.append(dict(x))
    return out


def find_matches(docs: DataFrame, bench: DataFrame, width: int = WIDTH, most: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text, k (a key of both), n_words, spans (maximal stretches of hit words:
    start, length), items (ids, as text, of the rows of ``bench`` (item_id, text) with an occurring window), longest (words
    of the longest verbatim match with a benchmark text, 0 below a window; counted within pieces of 4096 words).

    A window is ``width`` consecutive words of an item, or all words of one that has fewer but not none. A word of a document
    is hit if any occurrence of a window holds it. Null texts have no words; a null item_id is the empty text; items that
    share an id are one. Equal rows of ``docs`` are each judged alone. Other columns are dropped.
    """
    state = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    for i, block in enumerate(blocks(pieces(bench, width), F.octet_length("words") + F.octet_length("item") + 32, "item", "at", most=most)):
        tests = docs.sparkSession.sparkContext.broadcast(Tests(block.toArrow(), width))
        state = (cut(state) if i else state).mapInArrow(*_pass(tests, kind, width))
    return state


def judge(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 (of the items' ids sorted as text, comma-joined),
    contaminated, longest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return find_matches(docs, bench, width).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "longest")


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of ``bench`` occurs."""
    bad = cut(find_matches(docs, bench, width).filter("size(spans) > 0").select(F.col("k").alias("_bad")).distinct())
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("_bad"), "left_anti")
