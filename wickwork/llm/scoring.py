"""Scoring texts by prediction by partial matching over bytes, with a word unigram model as the base.

Counts of all byte strings of ``ORDER`` + 1 symbols in the training texts are gathered by Spark; they are the leaves of the
context trie, and shorter contexts follow by summing. A symbol is predicted in the longest context that was seen; an unseen
symbol escapes to the next shorter one with the probability of method C (distinct symbols over symbols plus distinct), and
symbols already refused by the longer context are excluded there.

What a symbol costs depends on itself and the ``ORDER`` symbols before it alone. So every string seen in training has one
log-probability, from two sums over its context; those of the most frequent strings are broadcast as a cache, all others
are joined. Strings not seen in training are dealt out by the two symbols before the last: all contexts of two and more
symbols that they can escape to then lie in one partition, and the shorter ones make a table of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import cut, fold
from wickwork.llm.textkernel import LOWER, Hashes, chunks, mix, words

ORDER = 5
#: Strings and words that are broadcast; all others are joined, so the numbers do not change a result.
HEAD, HEAD_WORDS = 1 << 20, 1 << 18
#: Strings of a partition of the trie that are held together.
TRIE_ROWS = 2_000_000
BITS = 9
START, END = 256, 257
SYMBOLS = 257
_NGRAM, _WORD = 0, 1


def symbols(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``order`` starts before and an end after each, and the row of each symbol."""
    n = len(off) - 1
    x = np.full(len(data) + n * (order + 1), START, np.int64)
    row = np.repeat(np.arange(n), np.diff(off) + order + 1)
    x[np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * order + np.arange(n), np.diff(off))] = LOWER[data]
    x[off[1:] + np.arange(1, n + 1) * (order + 1) - 1] = END
    return x, row


def ngrams(x: np.ndarray, order: int) -> np.ndarray:
    """Packed strings of order + 1 symbols for each symbol that is predicted."""
    at = np.flatnonzero(x != START)
    key = np.zeros(len(at), np.int64)
    for back in range(order, -1, -1):
        key = key << BITS | x[at - back]
    return key


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, row = words(data, off)
    return Hashes(LOWER[data]).of(start, end).view(np.int64), row


def _count(batches):
    """(kind, key, n) of one partition, combined as it goes."""
    held: dict[int, list] = {_NGRAM: [], _WORD: []}

    def merged(kind):
        keys = np.concatenate([k for k, _ in held[kind]])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        held[kind] = [(keys[first], np.add.reduceat(np.concatenate([n for _, n in held[kind]])[order], first))]

    for batch in batches:
        for _, _, data, off in chunks(batch.column(0), 1 << 19):
            x, _ = symbols(data, off, ORDER)
            for kind, keys in ((_NGRAM, ngrams(x, ORDER)), (_WORD, word_hashes(data, off)[0])):
                held[kind].append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held[kind]) > 2_000_000:
                    merged(kind)
    for kind in held:
        if held[kind] and sum(len(k) for k, _ in held[kind]):
            merged(kind)
            keys, n = held[kind][0]
            for at in range(0, len(keys), 100_000):
                k = keys[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 100_000].astype(np.int64))], ["kind", "key", "n"])


def _least(counts: DataFrame, most: int) -> int:
    """The smallest number such that at most ``most`` rows of ``counts`` have at least that ``n``.

    It is looked for among 1 to 2047 and the powers of two above, so the histogram has a bounded size.
    """
    step = F.when(F.col("n") < 2048, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    by = sorted(((r.b, r.c) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, above = 1, 0
    for b, c in by:
        above += c
        if above > most:
            return least
        least = b
    return 1


class Table:
    """Numbers by key: an open hash table over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = bits = max(4, int(2 * len(keys)).bit_length())
        self.slots, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, values.dtype)
        left, at = np.arange(len(keys)), _slot(keys, bits)
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[left[free]]  # of several the last stays
            placed = free & (self.slots[at] == keys[left])
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], at[~placed] + 1 & (1 << bits) - 1

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where there is none, and whether there is one."""
        value, found = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        i, at = np.arange(len(keys)), _slot(keys, self.bits)
        while len(i):
            got = self.slots[at]
            hit = got == keys[i]
            value[i[hit]], found[i[hit]] = self.values[at[hit]], True
            on = ~hit & (got != -1)
            i, at = i[on], at[on] + 1 & (1 << self.bits) - 1
        return value, found


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key.view(np.uint64)) >> np.uint64(64 - bits)).view(np.int64)


_tables: dict[int, tuple] = {}


def _table(shared) -> tuple:
    """The broadcast words as they are and the strings as a table, kept by the Python worker between batches."""
    if id(shared.value) not in _tables:
        _tables.clear()
        keys, logs, words_, n = shared.value
        _tables[id(shared.value)] = shared.value, Table(keys, logs), words_, np.log10(n + 0.5)
    return _tables[id(shared.value)][1:]


def _at(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in ``sorted_`` and whether they are there."""
    at = np.minimum(np.searchsorted(sorted_, keys), max(0, len(sorted_) - 1))
    return at, (sorted_[at] == keys if len(sorted_) else np.zeros(len(keys), bool))


def _mask(n: int) -> int:
    return (1 << BITS * n) - 1


def chain(levels: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last symbol of each key after those before it.

    ``levels[k]`` has the strings of ``k`` + 1 symbols in order, and their counts; it must hold all that any context of
    the keys was followed by.
    """
    stats = []
    for k, (strings, n) in enumerate(levels):
        contexts, at = np.unique(strings >> BITS, return_inverse=True)
        below = np.zeros(len(strings))
        if k:  # what the next shorter context gives to the symbols seen in this one
            shorter, there = _at(levels[k - 1][0], strings & _mask(k))
            below[there] = levels[k - 1][1][shorter[there]]
        stats.append((contexts, np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts)), np.bincount(at, below, len(contexts))))
    score, open_ = np.zeros(len(keys)), np.arange(len(keys))
    used = gone = kinds_gone = np.zeros(len(keys))  # whether a longer context is known, what it excludes here, its kinds
    for k in range(len(levels) - 1, -1, -1):
        contexts, total, kinds, below = stats[k]
        key = keys[open_]
        c, known = _at(contexts, (key >> BITS) & _mask(k))
        s, seen = _at(levels[k][0], key & _mask(k + 1))
        if len(contexts):
            new = np.where(used[open_] > 0, np.maximum(kinds[c] - kinds_gone[open_], 0), kinds[c])
            rest = np.where(used[open_] > 0, total[c] - gone[open_], total[c]) + new
            gain = np.where(seen, levels[k][1][s], new)
            on = known & (new > 0)
            score[open_[on]] += np.log10(gain[on] / rest[on])
            used, gone, kinds_gone = used.copy(), gone.copy(), kinds_gone.copy()
            at = open_[known]
            used[at], gone[at], kinds_gone[at] = 1, below[c[known]], kinds[c[known]]
        open_ = open_[~(known & seen)]
    first = levels[0][0] if levels else ()
    score[open_] -= np.log10(max(1.0, SYMBOLS - len(first)))
    return score


def _unseen(low):
    """Rows (c2, key, n) sorted by c2, n = 0 for strings that are asked for -> (key, lp) of those.

    ``low`` has the strings of one and two symbols with their counts."""

    def answer(held):
        keys, n = (np.concatenate([h[t] for h in held]) for t in (1, 2))
        ask = np.unique(keys[n == 0])
        if not len(ask):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64())], ["key", "lp"])
        keys, n = keys[n > 0], n[n > 0]
        levels = list(low.value)
        for k in range(2, ORDER + 1):
            strings, at = np.unique(keys & _mask(k + 1), return_inverse=True)
            levels.append((strings, np.bincount(at, n, len(strings)) if len(strings) else np.empty(0)))
        return pa.RecordBatch.from_arrays([pa.array(ask), pa.array(chain(levels, ask))], ["key", "lp"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            c2, key, n = (np.asarray(c) for c in batch.columns)
            if held and size > TRIE_ROWS:
                # Up to where the contexts of the last row begin all is complete.
                last = held[-1][0][-1]
                at = int(np.searchsorted(c2, last, "right"))
                held.append((c2[:at], key[:at], n[:at]))
                if at < len(c2):
                    yield answer(held)
                    held, size = [], 0
                c2, key, n = c2[at:], key[at:], n[at:]
            if len(c2):
                held.append((c2, key, n))
                size += len(c2)
        if held:
            yield answer(held)

    return run


def gather(docs: DataFrame) -> DataFrame:
    """Counts (kind, key, n) of symbol strings and words over all training rows."""
    found = docs.filter("not held_out").select("text").mapInArrow(_count, "kind int, key long, n long")
    return cut(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def strings_of(counts: DataFrame) -> DataFrame:
    """(key, n, lp) of every string seen in training: its count, and log10 of its last symbol's probability after the others."""
    top = counts.filter(F.col("kind") == _NGRAM).select("key", "n", F.shiftright("key", BITS).alias("context"))
    sums = top.groupBy("context").agg((F.sum("n") + F.count("*")).alias("all"))
    return cut(top.join(sums, "context").select("key", "n", (F.log10("n") - F.log10("all")).alias("lp")))


def _low(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The strings of one and of two symbols, 257 and 257 * 258 at most, with their counts."""
    out = []
    for k in (1, 2):
        level = (counts.filter(F.col("kind") == _NGRAM).groupBy(F.col("key").bitwiseAND(_mask(k)).alias("key")).agg(F.sum("n").alias("n"))).toArrow().sort_by("key")
        out.append((level["key"].to_numpy(), level["n"].to_numpy().astype(float)))
    return out


def score(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from rows whose crc32(doc_id) modulo ``modulus`` is not ``held``. Text is lower-cased (A-Z); null is
    empty and has the end token alone. ``score`` is log10 of the probability of the bytes and their end. Equal rows are
    scored alike and each returned. With no training rows every token is unknown and bytes are uniform.
    """
    spark = docs.sparkSession
    held_docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id", modulus) == held).alias("held_out"))
    counts = gather(held_docs)
    ends = held_docs.filter("not held_out").count()
    tokens = counts.filter(F.col("kind") == _WORD)
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    word_least = _least(tokens, HEAD_WORDS)
    words_ = tokens.filter(F.col("n") >= word_least).select("key", "n").toArrow().sort_by("key")
    strings = strings_of(counts)
    least = _least(strings, HEAD)
    head = strings.filter(F.col("n") >= least).select("key", F.col("lp").cast("float").alias("lp")).toArrow()
    shared = spark.sparkContext.broadcast((head["key"].to_numpy(), head["lp"].to_numpy(), words_["key"].to_numpy(), words_["n"].to_numpy()))
    whole = float(np.log10(train + 0.5 * (distinct + 1)))

    def lists(row, rows, keys):
        rest = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
        return pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(keys))

    def run(batches):
        table, keys, logs = _table(shared)
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1), 1 << 19):
                rows = hi - lo
                x, of = symbols(data, off, ORDER)
                of = of[x != START]
                string = ngrams(x, ORDER)
                lp, seen = table.find(string)
                h, row = word_hashes(data, off)
                at, found = _at(keys, h)
                base = np.bincount(row[found], logs[at[found]], rows).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(2).slice(lo, rows), pa.array(np.bincount(row, minlength=rows) + 1),
                     pa.array(np.bincount(row[found], minlength=rows)), pa.array(base), pa.array(np.bincount(of, lp, rows).astype(float)),
                     lists(row[~found], rows, h[~found]), lists(of[~seen], rows, string[~seen])],
                    ["doc_id", "held_out", "n_tokens", "n_head", "base", "head_score", "words", "strings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(held_docs.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, base double, head_score double, words array<long>, strings array<long>")
        .withColumn("uid", F.monotonically_increasing_id()))
    word_tail = rows.select("uid", F.lit(_WORD).alias("kind"), F.explode("words").alias("key"))
    string_tail = rows.select("uid", F.lit(_NGRAM).alias("kind"), F.explode("strings").alias("key"))
    asked = string_tail.select("key").distinct().join(strings.select("key"), "key", "left_anti")
    c2 = F.shiftright("key", BITS).bitwiseAND(_mask(2)).alias("c2")
    dealt = strings.select(c2, "key", "n").unionByName(asked.select(c2, "key", F.lit(0).cast("long").alias("n")))
    unseen = dealt.repartition("c2").sortWithinPartitions("c2").mapInArrow(_unseen(spark.sparkContext.broadcast(_low(counts))), "key long, lp double")
    known = (tokens.filter(F.col("n") < word_least).select(F.lit(_WORD).alias("kind"), "key", F.log10(F.col("n") + 0.5).alias("value"))
             .unionByName(strings.filter(F.col("n") < least).select(F.lit(_NGRAM).alias("kind"), "key", F.col("lp").alias("value")))
             .unionByName(unseen.select(F.lit(_NGRAM).alias("kind"), "key", F.col("lp").alias("value"))))
    is_word = F.col("kind") == _WORD
    tail = word_tail.unionByName(string_tail).join(known, ["kind", "key"], "left").groupBy("uid").agg(
        F.sum(F.when(is_word, F.coalesce("value", F.log10(F.lit(0.5))))).alias("tail_base"), F.count(F.when(is_word, F.col("value"))).alias("tail_known"),
        F.sum(F.when(~is_word, F.col("value"))).alias("tail_score"))
    end, zero = float(np.log10(ends + 0.5)), F.lit(0.0)
    return rows.drop("words", "strings").join(tail, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero) + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", zero)).alias("score"))
