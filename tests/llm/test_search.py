"""Decontamination, periodic runs and lexical search against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickwork.llm import decontamination, lexical, periodic

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- decontamination


def brute_hits(docs, items, width):
    windows = {}
    for item, text in items:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(text))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def judged(spark, docs, items, width=10):
    got = decontamination.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width).drop("longest").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 3), (3, 5)])
def test_hits_equal_brute_force(spark, seed, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "Γάμμα", "d3", "e", "É", "zeta"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, width - 1, width, width + 4, 40])))) for i in range(12) if i != 5]
    items += [(3, "same id, other text " * 4), (None, "an item without an id " * 3), (90, None), items[7], (91, items[7][1])]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            parts[5:5] = (rng.choice(items)[1] or "").split()
        docs.append((i % 50, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(None, None), (7, ""), (8, "-- !!"), (9, items[2][1])]
    assert judged(spark, docs, items, width) == brute_hits(docs, items, width)


def test_blocks_and_pieces_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(50))) for i in range(20)]
    docs = [(i, " ".join([items[i % 20][1][: 40 + i], "x y z", items[(i + 3) % 20][1][30:]])) for i in range(30)]
    want = judged(spark, docs, items)
    assert want == brute_hits(docs, items, 10) and any(w[3] > 1 for w in want)
    monkeypatch.setattr(decontamination, "PIECE", 16)
    assert judged(spark, docs, items) == want
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    some = decontamination.find_matches(d, b, most=1500).collect()  # several passes
    whole = decontamination.find_matches(d, b).collect()
    assert sorted((r.doc_id, r.n_words, tuple(r.spans), tuple(sorted(r["items"])), r.longest) for r in some) == sorted(
        (r.doc_id, r.n_words, tuple(r.spans), tuple(sorted(r["items"])), r.longest) for r in whole)


def test_longest_match_and_removal(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(1, f"one two {passage} three"), (2, "clean text of its own"), (3, " ".join(passage.split()[4:18])), (3, "another of id 3"), (None, None)], DOCS).withColumn("k", F.lit("clash"))
    bench = spark.createDataFrame([(1, f"intro {passage} outro")], ITEMS)
    found = {r.doc_id: r for r in decontamination.find_matches(docs.filter("doc_id <> 3 or text like 'p%'"), bench).collect()}
    assert (found[1].longest, found[3].longest, found[2].longest) == (25, 14, 0)
    assert [tuple(s) for s in found[1].spans] == [(2, 25)]
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (2, "clean text of its own"), (3, "another of id 3")]


def test_decontamination_of_awkward_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "a " * 3000)], ITEMS).withColumn("n", F.lit("clash"))
    assert decontamination.judge(odd_docs, bench).count() == odd_docs.count()
    assert decontamination.judge(odd_docs, bench).filter("contaminated").count() == 3
    assert decontamination.judge(no_docs, bench).count() == 0
    assert decontamination.judge(odd_docs, bench.limit(0)).filter("contaminated or n_items > 0").count() == 0
    began = time.time()
    assert decontamination.judge(spark.createDataFrame([(1, "a " * 40_000)], DOCS), bench).first().n_hit == 40_000
    assert time.time() - began < 60


# ---- periodic runs


def brute_runs(w, least, times):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda t: (t[0], t[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (3, 3), (8, 5)])
def test_runs_equal_brute_force(least, times):
    rng = np.random.default_rng(least)
    for _ in range(400):
        rows = []
        for _ in range(rng.integers(1, 4)):
            w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 50)).tolist()
            if rng.random() < 0.5 and len(w) > 10:
                a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 8))
                w = [w[i if i < a else a + (i - a) % p] for i in range(len(w)) if i < a or a + (i - a) % p < len(w)]
            rows.append(w)
        off = np.cumsum([0] + [len(w) for w in rows])
        got = periodic.find_runs(np.array([x for w in rows for x in w], np.uint64), off, least, times)
        assert list(zip(*(c.tolist() for c in got), strict=True)) == [(i, *r) for i, w in enumerate(rows) for r in brute_runs(w, least, times)]


def test_overlap_free_and_highly_periodic_words():
    thue_morse = np.array([bin(i).count("1") % 2 for i in range(1 << 12)], np.uint64)
    assert not len(periodic.find_runs(thue_morse, np.array([0, len(thue_morse)]), 3, 3)[0])
    began = time.time()
    same = np.zeros(200_000, np.uint64)
    assert [c.tolist() for c in periodic.find_runs(same, np.array([0, len(same)]))] == [[0], [0], [200_000], [1]]
    assert time.time() - began < 20
    with pytest.raises(ValueError):
        periodic.find_runs(same, np.array([0, len(same)]), 6, 2)


def test_collapsed_text_and_digest(spark, odd_docs, no_docs):
    text = "so  a b c a b c\ta b c a b c a\nb end end end end end end end"
    got = periodic.collapse_runs(spark.createDataFrame([(1, text)], DOCS)).first()
    assert [tuple(r) for r in got.runs] == [(1, 14, 3), (15, 7, 1)] and got.collapsed == "so a b c end" and got.n_words == 22
    row = periodic.digest(periodic.collapse_runs(spark.createDataFrame([(1, text)], DOCS))).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 15, 7, 1, 7000)
    assert row.runs_sha256 == hashlib.sha256(b"1,14,3\n15,7,1\n").hexdigest()
    out = periodic.collapse_runs(odd_docs)
    assert out.count() == odd_docs.count() and out.filter("collapsed is null or runs is null").count() == 0
    assert {r.collapsed for r in out.filter("doc_id in (1, 2, 3)").collect()} == {""}
    assert periodic.digest(periodic.collapse_runs(no_docs)).count() == 0


def test_planted_runs(spark):
    docs = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "kept as it is")]
    got = periodic.with_planted(spark.createDataFrame(docs, DOCS)).collect()
    for (doc, text), row in zip(docs, got, strict=True):
        w = text.split()
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            text = " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))
        assert (row.doc_id, row.text) == (doc, text)


# ---- lexical search


def brute_ranks(docs, items, top):
    terms = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    total, size, df = len(held), sum(len(t) for _, t in held), {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for d, t in held:
            m = 25 + 75 * len(t) * total // size
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in terms(text) if x in t)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 24, 20_000])
def test_ranks_equal_brute_force(spark, most):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "The", "of", "rare" + str(rng.randrange(40)), "Éa", "x1"])
    docs = [(i, rng.choice([" ", ".", "\n"]).join(word() for _ in range(rng.randrange(40)))) for i in range(150)]
    docs += [docs[4], docs[4], (None, "the rare1 rare2"), (400, None), (401, "..."), (402, "unrelated")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(25)] + [(50, "nowhere"), (51, None), (52, "the the the rare3"), (52, "the the the rare3")]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS), 5, most).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_ranks(docs, items, 5)


def test_lexical_search_of_awkward_rows(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "alpha one"), (2, None), (3, "word5 " * 200 + "x")], ITEMS).withColumn("item", F.lit("clash")).withColumn("rank", F.lit(1))
    want = sorted((tuple(r) for r in lexical.search(odd_docs, items).collect()), key=repr)
    assert {r[0] for r in want} == {1, 3}
    monkeypatch.setattr(lexical, "CELLS", 2)
    monkeypatch.setattr(lexical, "POSTINGS", 1)
    assert sorted((tuple(r) for r in lexical.search(odd_docs, items).collect()), key=repr) == want
    assert lexical.search(no_docs, items).count() == 0 and lexical.search(odd_docs, items.limit(0)).count() == 0
