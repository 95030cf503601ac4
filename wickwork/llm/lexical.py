"""Ranked lexical search, reversed: the items are indexed, the documents stream past.

The items' terms are an inverted index small enough for every task (items come in blocks of a bounded size, each block one
pass). A first pass over the documents counts them, their terms, and for each indexed term the documents that hold it; counts
leave a task as one row for each term. The second pass streams every document's term counts through the index: each posting
adds to the score of its item, and each task keeps one bounded heap per item. Heaps of ``top`` rows are all that is shuffled;
they are merged in two rounds. Scores are 64-bit integers, so they do not depend on the order of additions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.shared import BLOCK_BYTES, blocks, cut
from wickwork.llm.textkernel import LOWER, MARKS, Hashes, chunks, column_bytes, words

TOP = 10
#: Bytes that one more item takes in a task beside its terms.
ITEM_BYTES = 2048
#: Scores held at once.
CELLS = 1 << 21
#: Postings added at once.
POSTINGS = 1 << 21
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Index:
    """The items of a block: sorted term hashes, for each term its postings (item, times the item repeats it)."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        n = table.num_rows
        column = table.column("term").combine_chunks() if n else pa.array([], pa.string())
        data, off = column_bytes(column)
        data, off = data[off[0] : off[-1]], off - off[0]
        self.items, item = np.unique(np.asarray(table.column("item")) if n else np.empty(0, np.int64), return_inverse=True)
        hashes = Hashes(data).of(off[:-1], off[1:])
        by = np.lexsort((item, hashes))
        self.vocabulary, first = np.unique(hashes[by], return_index=True)
        self.first = np.append(first, n)
        self.item, self.times = item[by].astype(np.int64), (np.asarray(table.column("times")).astype(np.int64) if n else np.empty(0, np.int64))[by]

    def counts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each document, then document, indexed term and count of each pair that occurs, by document."""
        start, end, row = words(data, off, MARKS)
        n = np.bincount(row, minlength=len(off) - 1)
        none = np.empty(0, np.int64)
        if not len(self.vocabulary) or not len(row):
            return n, none, none, none
        h = Hashes(LOWER[data]).of(start, end)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        on = self.vocabulary[at] == h
        pair, times = np.unique(row[on] * len(self.vocabulary) + at[on], return_counts=True)
        return n, pair // len(self.vocabulary), pair % len(self.vocabulary), times


def _count(index):
    """Texts -> (term, documents that hold it); term -1: documents with a term, -2: terms of all documents."""

    def run(batches):
        known = index.value
        held, docs, terms = np.zeros(len(known.vocabulary), np.int64), 0, 0
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                n, _, term, _ = known.counts(data, off)
                docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
                held += np.bincount(term, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(held[some], [docs, terms]))], ["term", "n"])

    return run


class Heaps:
    """The best ``top`` documents of each item so far, by score, then smaller id."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.append(self.item, item), np.append(self.score, score), np.append(self.doc, doc)
        by = np.lexsort((doc, -score, item))
        item, score, doc = item[by], score[by], doc[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        on = place < self.top
        self.item, self.score, self.doc = item[on], score[on], doc[on]
        full = place == self.top - 1
        self.least[item[full]] = score[full]


#: Ids in heaps: a null id comes after all others.
_NULL = np.iinfo(np.int64).max


def _score(index, weight, n_docs: int, n_terms: int, top: int):
    """(doc_id, text) -> (item, doc_id, score), the heaps of a task."""

    def run(batches):
        known, w = index.value, weight.value
        heaps, size = Heaps(len(known.items), top), np.diff(known.first)
        most = max(1, CELLS // max(1, len(known.items)))
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(_NULL))
            for lo, hi, data, off in chunks(batch.column(1)):
                n, doc, term, tf = known.counts(data, off)
                big = max(int(n.max()), 1) * 75 * n_docs >= 2**62
                m = 25 + np.array([75 * int(x) * n_docs // n_terms for x in n], np.int64) if big else 25 + 75 * n * n_docs // max(n_terms, 1)
                gain = w[term] * ((10**9 * tf) // (1000 * tf + 8 * m[doc]))
                for a in range(0, hi - lo, most):
                    some = slice(*np.searchsorted(doc, [a, a + most]))
                    cells = np.zeros((min(most, hi - lo - a), len(known.items)), np.int64)
                    d, t, g = doc[some] - a, term[some], gain[some]
                    ends = np.cumsum(size[t])
                    for u, v in _parts(ends):
                        s = size[t[u:v]]
                        pick = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(known.first[t[u:v]], s)
                        np.add.at(cells.reshape(-1), np.repeat(d[u:v] * len(known.items), s) + known.item[pick], np.repeat(g[u:v], s) * known.times[pick])
                    x, y = np.nonzero((cells > 0) & (cells >= heaps.least))
                    heaps.offer(y, cells[x, y], ids[lo + a + x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(known.items[heaps.item], pa.int64()), pa.array(heaps.doc, pa.int64(), mask=heaps.doc == _NULL), pa.array(heaps.score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _parts(ends: np.ndarray):
    """Bounds of stretches with at most about ``POSTINGS`` postings each; ``ends`` are running totals."""
    u = 0
    while u < len(ends):
        v = max(u + 1, int(np.searchsorted(ends, (ends[u - 1] if u else 0) + POSTINGS, "right")))
        yield u, v
        u = v


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of ``docs`` (doc_id: whole number, text) for each item of ``items`` (item_id, text): item_id,
    rank, doc_id, score; scores above 0, highest first, equal scores by smaller doc_id (null last).

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Of N documents with a term and L
    terms in all of them, one with n terms has m = 25 + (75 n N) div L; a term in df documents weighs
    floor(1000 ln((2N + 2) / (2df + 1))), and adds its weight times (10^9 tf) div (1000 tf + 8m), as often as the item repeats
    it. Null texts have no terms. Repeated documents are ranked each; items with equal id and text are one item, different
    texts under one id are ranked apart. Other columns are dropped. The two passes read ``docs`` from its source.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    names = cut(keyed.select("item", "item_id"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = keyed.select("item", F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    share = F.lit(ITEM_BYTES) / F.count("*").over(Window.partitionBy("item"))
    heaps = None
    for block in blocks(terms.withColumn("bytes", F.octet_length("term") + 40 + share), F.col("bytes"), "item", most=most):
        known = Index(block.select("item", "term", "times").toArrow())
        index = spark.sparkContext.broadcast(known)
        counts = cut(docs.select("text").mapInArrow(_count(index), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))
        n_docs, n_terms = (counts.filter(F.col("term") == t).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (-1, -2))
        weights = counts.filter("term >= 0").select("term", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("n") + 1))).cast("long").alias("w")).toArrow()
        w = np.zeros(len(known.vocabulary), np.int64)
        w[np.asarray(weights.column("term"))] = np.asarray(weights.column("w"))
        found = docs.mapInArrow(_score(index, spark.sparkContext.broadcast(w), n_docs, n_terms, top), "item long, doc_id long, score long")
        heaps = found if heaps is None else heaps.unionByName(found)
    best = heaps.withColumn("part", F.spark_partition_id() % 64)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["item", "part"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
