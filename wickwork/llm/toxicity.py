"""Toxicity by a learned lexicon in a trie, misspellings by Levenshtein automata, and context windows.

Terms are words, and stems that begin many words, which the labels tie to toxic documents; they are counted by Spark over
a bounded sample of labelled rows. A word is run through the product of the trie and the Levenshtein automata of its
terms: states are sets of trie nodes with the edits used, on the paths of terms that a few deletions make equal to it. Hits are told
apart by kind (word, stem, misspelling) and by context: inside quotation marks, or soon after a word of report, or not.
A logistic regression over these few features, fitted on labelled rows that the lexicon has not seen, gives the score.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.llm.shared import cut, fold
from wickwork.llm.textkernel import release

#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
SAMPLE = 20_000
#: Terms kept.
TERMS = 5_000
LEAST_ROWS, LEAST_PRECISION, STEM_WORDS = 3, 0.8, 3
THRESHOLD = 0.7
WINDOW = 6
#: Words that a task remembers, and characters of text that it looks up together.
KNOWN, TOGETHER = 250_000, 1 << 19
#: Bits of the slots (one bit each) of the table of what edits leave of the terms.
SLOTS = 24
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@$*!](?=[^\W_]))*")
#: Words of report in the four languages of the tables.
_REPORT = frozenset("said says wrote writes quoted called told dit écrit appelé sagte schrieb nannte dijo escribió llamó".split())
#: Opening marks with those that close them.
_MARKS = (("“", "”"), ("«", "»"), ("„", "“”"))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """The trie of the terms, and with it the automaton of all words within a term's edits, at any letter."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: set[str]):
        self.words, self.stems = words, stems
        self.stem_lengths = sorted({len(s) for s in stems})
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.path: dict[str, list[int]] = {}
        for w in sorted(fuzzy):
            at, self.path[w] = 0, []
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                at = self.next[at][c]
                self.path[w].append(at)
            self.term[at] = w
        # The most edits that any term below a node allows.
        self.room = [0] * len(self.next)
        for node in range(len(self.next) - 1, -1, -1):
            self.room[node] = max([edits(self.term[node]) if self.term[node] else 0, *(self.room[x] for x in self.next[node].values())])
        # Where a term and a word within its edits meet: what is left of each when the edits are taken out or blotted.
        self.longest = max(map(len, fuzzy), default=0) + 2
        self.terms, keys = [], []
        for group, n, left in _blotted(fuzzy):
            k = edits(group[0])
            for (cuts, blots), hashes in left.items():
                if cuts + blots <= k:
                    keys.append((_salted(hashes, k, cuts, blots).ravel(), np.tile(np.arange(len(group)) + len(self.terms), len(hashes))))
            self.terms += group
        flat = np.concatenate([h for h, _ in keys]) if keys else np.empty(0, np.uint64)
        by = np.argsort(flat)
        self.keys, self.of = flat[by], (np.concatenate([t for _, t in keys])[by] if keys else np.empty(0, np.int64))
        slots = np.zeros(1 << SLOTS, bool)
        slots[_slot(self.keys)] = True
        self.slots = np.packbits(slots, bitorder="little")
        self.known: dict[str, tuple[int, float] | None] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Look up all ``words`` that are not known yet. Forgetting what is known bounds memory and changes no result."""
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update((w, self.exact(w)) for w in new)
        for word, terms in self.near(w for w in new if self.known[w] is None).items():
            if term := self.nearest(word, terms):
                self.known[word] = 3, self.words[term]

    def near(self, words: Iterable[str]) -> dict[str, set[str]]:
        """The terms that each word is within the edits of."""
        out: dict[str, set[str]] = {}
        for group, _, left in _blotted(w for w in words if len(self.keys) and 4 <= len(w) <= self.longest):
            for (cuts, blots), hashes in left.items():
                for k, cut_ in _MEET[cuts, blots]:
                    salted = _salted(hashes, k, cut_, blots)
                    slot = _slot(salted).ravel()
                    at = np.flatnonzero(self.slots.take(slot >> 3) >> (slot & 7).astype(np.uint8) & 1)
                    found = salted.ravel()[at]
                    lo, hi = np.searchsorted(self.keys, found), np.searchsorted(self.keys, found, "right")
                    at = at % len(group)
                    for at, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                        out.setdefault(group[at], set()).update(self.terms[t] for t in self.of[a:b])
        return out

    def _state(self, items, below: dict[int, dict[str, int]]) -> dict[int, int]:
        """Trie nodes, of those ``below``, with the least edits that reach them."""
        least: dict[int, int] = {}
        stack = list(items)
        while stack:  # skipping a letter of the term
            node, used = stack.pop()
            if used <= self.room[node] and least.get(node, 99) > used:
                least[node] = used
                stack += [(x, used + 1) for x in below[node].values()]
        return least

    def nearest(self, word: str, terms: set[str]) -> str | None:
        """Of ``terms`` the one nearest to ``word``, if within its edits: the automaton's states on the terms' branches."""
        below: dict[int, dict[str, int]] = {}
        for t in terms:
            at = 0
            for c, node in zip(t, self.path[t], strict=True):
                below.setdefault(at, {})[c] = at = node
            below.setdefault(at, {})
        state = self._state([(0, 0)], below)
        for c in word:
            items = []
            for node, used in state.items():
                items.append((node, used + 1))
                items += [(x, used + (letter != c)) for letter, x in below[node].items()]
            state = self._state(items, below)
            if not state:
                return None
        found = [(used, self.term[node]) for node, used in state.items() if self.term[node] and used <= edits(self.term[node])]
        return min(found)[1] if found else None

    def misspelt(self, word: str) -> str | None:
        """The term nearest to ``word`` within its edits, or None."""
        terms = self.near([word])
        return self.nearest(word, terms[word]) if terms else None

    def exact(self, word: str) -> tuple[int, float] | None:
        """(kind, weight), the kind being 1 for a word and 2 for a stem; None for no hit."""
        if word in self.words:
            return 1, self.words[word]
        for n in self.stem_lengths:
            if len(word) > n and word[:n] in self.stems:
                return 2, self.stems[word[:n]]
        return None


#: Letters cut from and blotted in a word -> the edits of the terms, and the letters cut from them, that it may meet.
_MEET = {(0, 0): ((0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)), (1, 0): ((1, 0), (2, 0), (2, 1)), (2, 0): ((2, 0),), (0, 1): ((1, 0), (2, 0), (2, 1)), (1, 1): ((2, 0),), (0, 2): ((2, 0),)}


def _salted(hashes: np.ndarray, k: int, cuts: int, blots: int) -> np.ndarray:
    return hashes + np.uint64((k * 9 + cuts * 3 + blots) * 0xC2B2AE3D27D4EB4F % 2**64)


def _slot(salted: np.ndarray) -> np.ndarray:
    return (salted * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOTS)).view(np.int64)


def _blotted(words: Iterable[str]) -> Iterator[tuple[list[str], int, dict[tuple[int, int], np.ndarray]]]:
    """Words of one length, the length, and by (letters cut, letters blotted) the hashes (choice, word) of what is left."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for n, all_ in by.items():
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)), dtype=np.uint64)
        down, down2 = np.uint64(_INVERSE), np.uint64(_INVERSE * _INVERSE % 2**64)
        for at in range(0, len(all_), 500):
            group = all_[at : at + 500]
            letters = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(group), n).astype(np.uint64).T
            sums = np.zeros((n + 1, len(group)), np.uint64)
            np.cumsum(letters * powers[:n, None], axis=0, out=sums[1:])
            blot = (np.uint64(1) - letters) * powers[:n, None]
            cut_ = sums[:n] + (sums[n] - sums[1:]) * down
            pairs, apart = np.triu_indices(n, 1), [np.delete(np.arange(n), i) for i in range(n)]
            i, j = pairs
            left = {(0, 0): sums[n:], (1, 0): cut_, (0, 1): sums[n] + blot}
            if n > 5:
                left[2, 0] = sums[i] + (sums[j] - sums[i + 1]) * down + (sums[n] - sums[j + 1]) * down2
                left[0, 2] = sums[n] + blot[i] + blot[j]
                left[1, 1] = np.concatenate([cut_[t] + np.where((x > t)[:, None], blot[x] * down, blot[x]) for t, x in enumerate(apart)])
            yield group, n, left


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * 9)

    def automaton(self) -> Automaton:
        return Automaton(self.words, self.stems, {w for w in self.words if edits(w)})


class _Marks:
    """Where the lines and quotation marks of a text are."""

    def __init__(self, text: str):
        self.feeds, self.straight = _places(text, "\n"), _places(text, '"')
        self.pairs = [(_places(text, a), _places(text, b)) for a, b in _MARKS]

    def quoted(self, at: int) -> bool:
        """Whether position ``at`` stands inside quotation marks of its line."""
        i = bisect_left(self.feeds, at)
        line = self.feeds[i - 1] if i else -1
        if (bisect_left(self.straight, at) - bisect_left(self.straight, line)) % 2:
            return True
        for opening, closing in self.pairs:
            i, j = bisect_left(opening, at), bisect_left(closing, at)
            if i and opening[i - 1] > line and (not j or closing[j - 1] < opening[i - 1]):
                return True
        return False


def _places(text: str, marks: str) -> list[int]:
    return [m.start() for m in re.finditer(f"[{marks}]", text)] if any(m in text for m in marks) else []


def _features(text: str, words: list[str], known: dict) -> list[float]:
    kinds = [known[w] for w in words]
    plain, quoted, terms = [0.0] * 4, 0.0, set()
    if any(kinds):
        low = text.lower()
        marks = _Marks(low)
        for i, m in enumerate(_TOKEN.finditer(low)):
            if kinds[i]:
                kind, weight = kinds[i]
                if marks.quoted(m.start()) or not _REPORT.isdisjoint(words[max(0, i - WINDOW) : i]):
                    quoted += weight
                else:
                    plain[kind] += weight
                    terms.add(words[i])
    hits = sum(plain)
    return [1.0, *np.log1p(plain[1:]), np.log1p(quoted), float(hits > 0), np.log1p(len(terms)), hits / (len(words) + 10), np.log1p(len(words)) / 10]


def features(texts: Iterable[str | None], automaton: Automaton) -> list[list[float]]:
    """The features of each text; a null is an empty text."""
    out, held, size = [], [], 0

    def flush():
        split = [tokens(t) for t in held]
        automaton.learn(set().union(*split))
        out.extend(_features(t, words, automaton.known) for t, words in zip(held, split, strict=True))
        held.clear()

    for t in texts:
        t = t.as_py() if isinstance(t, pa.Scalar) else t
        held.append(t or "")
        size += len(held[-1])
        if size > TOGETHER:
            flush()
            size = 0
    flush()
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Newton's method for a ridge logistic regression; the intercept is not held back."""
    w = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(hold + 1e-9), x.T @ (y - p) - hold * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _terms(rows: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean, words): rows of each label that hold the term, and the words a stem begins."""

    def run(batches):
        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                words = set(tokens(text or ""))
                out += [(w, "", y) for w in words if 1 < len(w) <= 40]
                out += [(s, w, y) for w in words for s in {w[:4], w[:5], w[:6]} if len(w) > len(s) >= 4]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["term", "word", "toxic"])
                    out = []
            yield pd.DataFrame(out, columns=["term", "word", "toxic"])

    found = rows.select("text", "toxic").mapInPandas(run, "term string, word string, toxic int")
    per_doc = found.groupBy("term", F.col("word") != "").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.countDistinct("word").alias("words"))
    return per_doc.toDF("term", "stem", "toxic", "clean", "words")


def _lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}, {}
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    good = (_terms(rows).withColumn("odds", odds)
            .filter((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
            .filter(~F.col("stem") | (F.col("words") >= STEM_WORDS)).filter("odds > 1.5")
            .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(TERMS).select("term", "stem", "odds").collect())
    return {r.term: r.odds for r in good if not r.stem}, {r.term: r.odds for r in good if r.stem}


def fit(docs: DataFrame, labels: DataFrame, held: int = 1, modulus: int = 3) -> Model:
    """A model from rows of ``docs`` that ``labels`` (doc_id, toxic) marks and whose crc32(doc_id) modulo ``modulus`` is
    not ``held``; at most ``SAMPLE`` of them. Without both labels among them the score is the share of toxic rows."""
    part = fold("doc_id", modulus)
    known = labels.filter(F.col("toxic").isin(0, 1) & (part != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # The sample is bounded, so it may be broadcast.
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", (part == (held + 1) % modulus).alias("check")))
    model = Model(*_lexicon(rows.filter("not check")))
    checked = rows.filter("check")

    def measure(batches):
        automaton = model.automaton()
        for pdf in batches:
            yield pd.DataFrame({"f": features(pdf["text"], automaton), "toxic": pdf["toxic"]})

    seen = checked.mapInPandas(measure, "f array<double>, toxic int").toPandas()
    y = seen["toxic"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        weights = _fit(np.stack(seen["f"].to_numpy()), y)
    else:
        weights = [float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), *[0.0] * 8]
    return Model(*_lexicon(rows), weights)


def _scores(shared, batches, column: str):
    """Each batch with the scores of its texts; what the task has learned goes when it ends."""
    model = shared.value
    automaton, w = model.automaton(), np.array(model.weights)
    gc.disable()  # millions of small objects and no cycles among them
    try:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            x = np.array(features(texts, automaton), float).reshape(len(batch), len(w))
            yield batch, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    finally:
        automaton.known.clear()
        gc.enable()
        release()


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held: int = 1, modulus: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted. Null and empty texts score like any text
    without hits. Equal texts score alike. Other columns are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held, modulus))

    def run(batches):
        for batch, score_ in _scores(shared, batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score_)], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", (fold("doc_id", modulus) == held).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic, columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch, score_ in _scores(shared, batches, "text"):
            yield batch.filter(pa.array(score_ < threshold))

    return docs.mapInArrow(run, docs.schema)
