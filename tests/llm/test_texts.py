"""Document operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wickwork.llm import jaccard, lines, mixing, packing, scoring, substrings, textkernel, toxicity
from wickwork.llm.queries import QUERIES, tokenizer_files

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def docs(tiny):
    return pq.read_table(f"{tiny}/documents.parquet").to_pandas()


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# op1 ----------------------------------------------------------------------------------------------------------------------

def strike(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, tiny, docs):
    got = QUERIES["op1_substrings"](spark, tiny).toPandas().sort_values("doc_id")
    want = strike([(t or "").encode() for t in docs.sort_values("doc_id").text], 400)
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == want
    assert got.n_removed.sum() > 0
    whole = got[got.n_removed == 0].set_index("doc_id").kept
    assert (whole == docs.set_index("doc_id").text.fillna("").loc[whole.index]).all() and (got.kept.map(len) <= got.n_bytes).all()


@pytest.mark.parametrize("hot", [1, 10_000])
def test_short_windows_and_split_anchors(spark, monkeypatch, hot):
    """Small windows make every case frequent; with a low limit all anchors take the path for hot ones."""
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 60))) * int(rng.integers(1, 3)) for _ in range(40)] + ["abc" * 40, "", "z" * 90]
    passage = "".join(rng.choice(list("abcdefgh"), 45))
    texts += ["".join(rng.choice(list("xyz"), 20)) + passage + "".join(rng.choice(list("uvw"), 20)) for _ in range(15)]
    monkeypatch.setattr(substrings, "BLOCK", 4)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.remove_repeats(d, 30, 8).toPandas().sort_values("doc_id")
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == strike([t.encode() for t in texts], 30)


def test_repeats_odd(odd_docs, no_docs):
    got = substrings.remove_repeats(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and substrings.remove_repeats(no_docs).count() == 0
    assert got[got.doc_id == 7].n_removed.tolist() == [3000] and got[got.doc_id == 0].n_removed.tolist() == [0]


# op2 ----------------------------------------------------------------------------------------------------------------------

def test_mix_meets_targets(spark, tiny, docs):
    got = QUERIES["op2_mixing"](spark, tiny).toPandas()
    assert dict(zip(got.doc_id, got["size"], strict=True)) == {i: len(words(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.assign(source=got.doc_id.map(docs.set_index("doc_id").source)).groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"), n=("size", "sum"))
    names = sorted(by.index, key=lambda s: s.encode())
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    level, capped, total = 0.0, set(), by.n.sum()
    while True:
        level = (total - sum(3 * by.n[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
        new = {s for s in names if weight[s] * level > 3 * by.n[s]}
        if new <= capped:
            break
        capped |= new
    want = {s: min(weight[s] * level, 3.0 * by.n[s]) for s in names}
    assert np.allclose([by.target[s] for s in names], [want[s] for s in names])
    assert (by["size"] == by.n).all() and abs(by.taken.sum() - total) < 0.002 * total
    assert (np.abs(by.taken - by.target) <= 0.01 * by.target).all(), by


def test_mix_reruns_agree(spark, tiny):
    a, b = (QUERIES["op2_mixing"](spark, tiny).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, p = np.sort(rng.integers(1, 500, 300)).astype(float)[::-1], rng.random(300)
    q = mixing.fly(p, size, rng.random(300))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs((q * size).sum() - (p * size).sum()) < 1e-3 and abs(q.sum() - p.sum()) < 1e-6


def test_landing_comes_near_what_is_expected():
    """Sizes over four orders of magnitude, few or many documents, one of them larger than all others together."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 12, 40, 500):
        size = np.sort(np.exp(rng.uniform(0, 9, n)).round())[::-1]
        size[0] = size.sum() + 10 if n == 40 else size[0]
        p = rng.random(n)
        q = mixing.land(p, size, rng.random(n))
        assert set(q) <= {0.0, 1.0}
        off, expected = abs((q * size).sum() - (p * size).sum()), (p * size).sum()
        if n <= 12:  # all choices
            sums = np.array([0.0])
            for x in size:
                sums = np.concatenate([sums, sums + x])
            assert math.isclose(off, np.abs(sums - expected).min(), abs_tol=1e-6)
        elif n == 500:
            assert off < 0.001 * expected


def test_mix_odd(odd_docs, no_docs):
    got = mixing.mix_counts(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and mixing.mix_counts(no_docs).count() == 0
    assert (got[got["size"] == 0].taken == 0).all()
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and sum(len(words(r.text)) for r in mixed.collect()) == got.taken.sum()


# op3 ----------------------------------------------------------------------------------------------------------------------

def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def classes(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts}
    held = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = collections.Counter((a, b) for ids in held.values() for n, b in enumerate(ids) for a in ids[:n])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return {i: len(s) for i, s in sets.items()}, roots(links, sets)


def test_near_duplicates_equal_brute_force(spark, tiny, docs):
    n, root = classes(list(zip(docs.doc_id, docs.text, strict=True)), 4, 85)
    for r in QUERIES["op3_ngram_jaccard"](spark, tiny).collect():
        assert (r.n_shingles, r.component_id) == (n[r.doc_id], root[r.doc_id])


@pytest.mark.parametrize("block", [4, 1024])
def test_chains_and_split_buckets(spark, monkeypatch, block):
    """Chains of edits whose ends are unlike, in one component through their middle."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    by_trees, trees = [], jaccard.tree_links

    def counted(*args):
        found = jaccard.cut(trees(*args))
        by_trees.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "tree_links", counted)
    rng = np.random.default_rng(6)
    texts = []
    for c in range(4):
        t = [f"w{c}_{rng.integers(400)}" for _ in range(120)]
        for _ in range(25):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.integers(len(t))] = f"x{rng.integers(10**6)}"
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    n, root = classes(rows, 4, 85)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == root and {r.doc_id: r.n_shingles for r in got} == n
    # 96 links join the four chains; nearly all come from the trees, unless the buckets are larger than one tree takes.
    assert by_trees[0] > (86 if block > 100 else 0)


def test_tree_of_sketches_equals_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (12, 128), dtype=np.uint8)
    group = rng.integers(0, 9, 150)
    sketches = base[rng.integers(0, 12, 150)]
    for row in sketches:
        at = rng.permutation(128)[: rng.integers(0, 70)]
        row[at] = rng.integers(0, 256, len(at))
    for agree in (40, 90, 120):
        want = [any((x == y).sum() >= agree and g != h for y, h in zip(sketches, group, strict=True)) for x, g in zip(sketches, group, strict=True)]
        assert jaccard.across(sketches, group, agree).tolist() == want


def test_distinct_hashes_are_sorted_not_hashed():
    """A set's distinct hashes take no longer than a sort of them, whatever bits they share."""
    x = np.random.default_rng(2).integers(0, 2**63, 300_000, dtype=np.uint64)
    x = np.repeat(np.arange(600, dtype=np.uint64) << np.uint64(48), 500) | (x >> np.uint64(16))
    n = np.full(600, 500)
    began = time.perf_counter()
    sets = jaccard.distinct(x << np.uint64(16), n)
    took = time.perf_counter() - began
    assert [s.tolist() for s in sets] == [sorted({v & (2**48 - 1) for v in x[i * 500 : i * 500 + 500].tolist()}) for i in range(600)]
    began = time.perf_counter()
    for _ in range(8):
        np.sort(x)
    assert took < time.perf_counter() - began
    assert textkernel.ascending(np.array([3, 1, 3, 2**63], np.uint64)).tolist() == [1, 3, 2**63] and len(textkernel.ascending(np.empty(0, np.uint64))) == 0


def test_small_groups_are_compared_at_once_and_lose_no_link(monkeypatch):
    """Neither a tree nor most of the pairs' exact comparisons are needed for a bucket of a few dozen nodes."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (6, 200), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.integers(6)][: rng.integers(170, 201)], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)])) for _ in range(60)]
    want = roots([(a, b) for a in range(60) for b in range(a) if jaccard.linked(sets[a], sets[b])], range(60))
    compared, exact = [], jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda *a: compared.append(a) or exact(*a))
    monkeypatch.setattr(jaccard, "SignatureTree", None)
    got = jaccard.search(list(range(60)), np.arange(60), sets)
    assert roots(got, range(60)) == want and len(set(want.values())) < 60 and len(compared) < 60 * 59 // 2 // 2
    odd = [np.empty(0, np.uint64), np.array([7], np.uint64), np.array([7], np.uint64), np.array([8], np.uint64)]
    assert jaccard.search([0, 1, 2, 3], np.arange(4), odd) == [(1, 2)]
    sketches = rng.integers(0, 3, (100, 64), dtype=np.uint8)
    group = rng.integers(0, 9, 100)
    for agree in (25, 30):
        alike = [any((x == y).sum() >= agree and g != h for y, h in zip(sketches, group, strict=True)) for x, g in zip(sketches, group, strict=True)]
        assert jaccard.across(sketches, group, agree).tolist() == alike


def test_band_keys_are_grouped_without_ordering_all_nodes():
    rng = np.random.default_rng(3)
    key = np.concatenate([rng.integers(0, 2**63, 300_000, dtype=np.uint64), rng.integers(0, 99, 2000, dtype=np.uint64)])
    node = rng.integers(0, 50, len(key), dtype=np.uint64)
    began = time.perf_counter()
    k, s, first, n = lines._grouped(key, node)
    took = time.perf_counter() - began
    pairs = sorted(set(zip(key.tolist(), node.tolist(), strict=True)))
    assert list(zip(k.tolist(), s.tolist(), strict=True)) == pairs
    times = collections.Counter(a for a, _ in pairs)
    assert n.tolist() == [times[a] for a, _ in pairs] and first.tolist() == [i == 0 or pairs[i - 1][0] != pairs[i][0] for i in range(len(pairs))]
    began = time.perf_counter()
    np.lexsort((node, key))
    assert took < time.perf_counter() - began
    assert [len(x) for x in lines._grouped(key[:1], node[:1])] == [1, 1, 1, 1]


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (6, 60), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.integers(6)][: rng.integers(40, 61)], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(80)]
    sets.sort(key=len)
    tree = jaccard.SignatureTree(sets, np.arange(len(sets)))
    kept = {(a, b) for i, j in tree.pairs() for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if jaccard.linked(sets[a], sets[b]):
                assert (a, b) in kept


def test_near_duplicates_odd(odd_docs, no_docs):
    got = jaccard.near_duplicates(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and jaccard.near_duplicates(no_docs).count() == 0
    assert got[got.doc_id == 6].component_id.tolist() == [0, 0] and got[got.doc_id == 3].n_shingles.tolist() == [0]
    kept = jaccard.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and 0 in ids and 6 not in ids and {1, 2, 3} <= set(ids)


def test_keep_one_of_null_and_equal_ids(spark):
    """Different texts under one id, or under none, are each kept; only a copy of another row goes."""
    unlike = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[2]), (3, unlike[2]), (4, unlike[3]), (4, unlike[4]), (4, unlike[4]), (5, unlike[3]), (None, unlike[5]), (None, unlike[5])]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == {(None, unlike[0]): 1, (None, unlike[1]): 1, (3, unlike[2]): 1, (4, unlike[3]): 1, (4, unlike[4]): 1, (None, unlike[5]): 1}


# op4 ----------------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_labels(spark, tiny):
    big = tiny.replace("sf0.001", "sf0.01")
    got = QUERIES["op4_toxicity"](spark, big).toPandas()
    y = pq.read_table(f"{big}/labels.parquet").to_pandas().set_index("doc_id").toxic
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    h = got[got.held_out & got.doc_id.isin(y.index)]
    pos, neg = h.score[h.doc_id.map(y) == 1].to_numpy(), h.score[h.doc_id.map(y) == 0].to_numpy()
    assert ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()) > 0.85
    assert (neg >= 0.7).mean() < 0.05


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "worthless", "scum", "losers", "clowns"]
    a = toxicity.Automaton(dict.fromkeys(terms, 1.0), {}, set(terms))
    rng = np.random.default_rng(3)
    for _ in range(3000):
        w = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(3)
            at = rng.integers(1, len(w) + 1)
            if k == 0:
                w.insert(at, "abcdeo"[rng.integers(6)])
            elif at < len(w):
                w[at : at + 1] = [] if k == 1 else ["abcdeo"[rng.integers(6)]]
        word = "".join(w)
        if len(word) >= 4:
            want = any(t[0] == word[0] and distance(word, t) <= toxicity.edits(t) for t in terms)
            assert (a.misspelt(word) is not None) == want, word


def test_misspellings_of_all_terms_and_first_letters():
    """Every term of five letters or more is searched for, whatever its weight, and edits at the first letter count."""
    rng = np.random.default_rng(9)
    terms = sorted({"".join(rng.choice(list("abcdefghijklmnop"), rng.integers(4, 11))) for _ in range(600)})
    a = toxicity.Model({w: 6.0 - i / 1000 for i, w in enumerate(terms)}).automaton()
    for w in rng.choice(terms[300:], 60):
        w = str(w)
        for typo in (f"z{w[1:]}", w[1:], f"z{w}", f"{w[:2]}z{w[3:]}"):
            near = [(distance(typo, t), t) for t in terms if 0 < distance(typo, t) <= toxicity.edits(t)]
            want = None if typo in terms or len(typo) < 4 or not near else min(near)[1]
            if typo not in terms:
                assert a.misspelt(typo) == want, (typo, w)
                a.learn([typo])
                assert a.known[typo] == (want and (3, a.words[want])), (typo, w)


def test_quotation_is_told_apart():
    a = toxicity.Automaton({"idiot": 5.0}, {}, {"idiot"})
    plain, quoted, said = toxicity.features(["you idiot go", 'he was no "idiot" then', "she said idiot there"], a)
    assert plain[1] > 0 and plain[4] == 0 and quoted[1] == 0 and quoted[4] > 0 and said[4] > 0
    assert toxicity.features(["you idi0t go"], a)[0][3] > 0


def test_quotation_marks_by_rescanning_each_line():
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list('ab"“”«»„\n'), 40))
        marks = toxicity._Marks(text)
        for at in range(len(text)):
            line = text[text.rfind("\n", 0, at) + 1 : at]
            want = line.count('"') % 2 == 1 or any(line.rfind(a) > max(map(line.rfind, b)) for a, b in toxicity._MARKS)
            assert marks.quoted(at) == want


def test_toxicity_odd(odd_docs, no_docs, labels):
    got = toxicity.score(odd_docs, labels).toPandas()
    assert len(got) == odd_docs.count() and got.score.between(0, 1).all() and toxicity.score(no_docs, labels).count() == 0
    assert toxicity.reject(odd_docs, labels.limit(0)).columns == odd_docs.columns


# op5 ----------------------------------------------------------------------------------------------------------------------

def char_grams(line):
    return frozenset(line[p : p + lines.GRAM] for p in range(len(line) - lines.GRAM + 1))


def lower(line):
    return line.encode().translate(LOWER).decode()


def test_lines_equal_brute_force(spark, tiny, docs):
    """All pairs of different lines that share a shingle are compared; the bands may miss 2 in 10 000 at the threshold."""
    texts = {r.doc_id: r.text for r in lines.dedup_lines(spark.read.parquet(f"{tiny}/documents.parquet")).collect()}
    rows = [(i, n, lower(ln)) for i, t in zip(docs.doc_id, docs.text, strict=True) for n, ln in enumerate((t or "").split("\n")) if len(ln) >= lines.GRAM]
    unlike = sorted({x for _, _, x in rows})
    grams = [char_grams(x) for x in unlike]
    by = collections.defaultdict(list)
    for at, g in enumerate(grams):
        for x in g:
            by[x].append(at)
    links = []
    for b, g in enumerate(grams):
        common = collections.Counter(a for x in g for a in by[x] if a < b)
        links += [(a, b) for a, c in common.items() if 100 * c >= 80 * (len(grams[a]) + len(g) - c)]
    root = roots(links, range(len(unlike)))
    at = {x: i for i, x in enumerate(unlike)}
    groups = collections.defaultdict(list)
    for i, n, x in rows:
        groups[root[at[x]]].append((i, n))
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    want = {i: "\n".join(ln for n, ln in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert links and {i for i in want if (texts[i] or "") != want[i]} == set()


def test_lines_of_other_alphabets_and_many_near_copies(spark, monkeypatch):
    """Characters, not bytes, make shingles; a large group of near copies is joined, also when it is dealt out in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("абвгдежзиклмнопрст"), 120))
    near = [base[:p] + "Ж" + base[p + 1 :] for p in range(10, 110)]
    far = ["".join(rng.choice(list("абвгдежзиклмнопрст"), 60)) for _ in range(20)]
    rows = [(i, x) for i, x in enumerate([base, *near, *far, "семьзна", "семьзна", "日本語日本語日", "日本語日本語日本"])]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == base and not any(got[i] for i in range(1, 101))
    assert all(got[i] == t for i, t in rows[101:])


def test_lines_odd(odd_docs, no_docs):
    got = lines.dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns and lines.dedup_lines(no_docs).count() == 0
    rows = got.collect()
    assert len(rows) == odd_docs.count() and sum(r.text is None for r in rows) == 2
    assert [r.text for r in rows if r.doc_id == 6] == ["", ""] and all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def test_of_repeated_rows_one_keeps_its_lines(spark):
    text = "a first line of some length\n\nshort\na second line, not like it"
    docs = spark.createDataFrame([(1, text, "a")] * 4 + [(1, text, "b")] * 2 + [(2, "a first line of some length\nits own words stay here", "c"), (3, "its own words stay here", "c")], "doc_id long, text string, source string")
    got = [tuple(r) for r in lines.dedup_lines(docs).collect()]
    assert len(got) == 8 and [r[1] for r in got if r[0] == 1].count(text) == 1 and [r[1] for r in got if r[0] == 1].count("\nshort") == 5
    assert sorted(r[2] for r in got if r[0] == 1) == ["a"] * 4 + ["b"] * 2
    assert sorted(r for r in got if r[0] > 1) == [(2, "its own words stay here", "c"), (3, "", "c")]


def test_many_copies_of_a_row_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "COPIES", 7)
    text = "a first line of some length\na second line, not like it"
    docs = spark.createDataFrame([(1, text, 0)] * 40 + [(1, text, None)] * 15 + [(2, "a first line of some length", 0), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = [tuple(r) for r in lines.dedup_lines(docs).collect()]
    assert got.count((1, text, len(text))) == 1 and got.count((1, "", 0)) == 54 and len(got) == 57
    assert (2, "", 0) in got and any(r[:2] == (3, None) for r in got)


def test_a_text_of_many_lines_is_cut_in_linear_time(spark):
    body = "\n".join(f"{i:06d} {i * 7919 % 100003:06d} {i * i % 99991:06d} words" for i in range(150_000))
    began = time.time()
    got = dict(lines.dedup_lines(spark.createDataFrame([(1, body), (2, body + "\nand one line more")], "doc_id long, text string")).collect())
    # Some of these lines are near duplicates of each other; whole they are gone from the second text.
    assert got[2] == "and one line more" and got[1].split("\n")[0] == body.split("\n")[0]
    assert time.time() - began < 120


def test_lines_at_the_threshold_share_a_bucket():
    """Of pairs of lines with Jaccard just over 0.8, at most one in two hundred shares no band."""
    rng = np.random.default_rng(12)
    missed = pairs = 0
    while pairs < 2000:
        a = rng.integers(97, 123, 87, dtype=np.uint8)
        b = a.copy()
        b[rng.choice([0, 86], 1)] = 48  # changes one shingle of 80
        for at in rng.choice(np.arange(20, 70), 1):
            b[at] = 49  # eight more: 71 of 89 are common
        ga, gb = ({bytes(x[p : p + 8]) for p in range(80)} for x in (a, b))
        if not 0.79 < len(ga & gb) / len(ga | gb) < 0.82:
            continue
        text = lines.Lines(np.concatenate([a, [10], b]).astype(np.uint8), np.array([0, 175]), False)
        key = lines.bands(text.signatures(np.arange(2)))
        pairs += 1
        missed += not (key[:, 0] == key[:, 1]).any()
    assert missed <= 10, missed


def test_short_lines_lose_their_repeats(spark):
    rows = [(1, "Menu\nshare this\n\n \nsome longer line of text"), (2, "menu\nShare this\n\n \nOther"), (3, "Menu"), (4, "Men")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, short=True).collect()}
    assert got == {1: rows[0][1], 2: "\n \nOther", 3: "", 4: "Men"}
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got[2] == "menu\n\n \nOther" and got[3] == "Menu"


# op6 ----------------------------------------------------------------------------------------------------------------------

def check_pieces(got, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_files()["json_path"])
    assert got.sequence_id.is_unique and (got.offset == 0).all() and got.length.map(lambda n: n & (n - 1) == 0 and n <= 2048).all()
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        p = got[got.doc_id == i].sort_values("start")
        assert p.length.sum() == len(ids) and (p.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(p.start, p.length, strict=True)] == p.ids_crc32.tolist()
        assert (p.start.to_numpy()[1:] == np.cumsum(p.length.to_numpy())[:-1]).all()


def test_pack_equals_the_tokenizer(spark, tiny, docs):
    check_pieces(QUERIES["op6_packing"](spark, tiny).toPandas(), list(zip(docs.doc_id, docs.text, strict=True)))


def test_pack_odd(spark, no_docs, odd_docs):
    texts = ["a  b", " lead", "trail ", "a\n\nb", "tab\there", "nb sp x", "½ cup ² ok", "\x1c sep", "it's we'll", "<|endoftext|> x", "日本語 text", "🙂 ok", "x" * 5000, None, "", "a \n b", "é́ z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.pack(d, **tokenizer_files()).toPandas(), list(enumerate(texts)))
    assert packing.pack(no_docs, **tokenizer_files()).count() == 0
    whole = packing.pack(odd_docs, **tokenizer_files(), with_ids=True).toPandas()
    assert (whole.ids.map(len) == whole.length).all()


def test_pack_random_unicode(spark):
    """The quick way to ids and the tokenizer agree on mixed scripts, blanks, marks and controls."""
    rng = np.random.default_rng(8)
    pools = ["abcXYZ 0123456789", " \t\n\r\u00a0\u2003\u3000", ".,;:!?'\"()[]{}<>|/\\@#$%^&*-_=+~`", "äöüßéèñçøåæ", "дйцукеЖЩ", "日本語漢字かなカナ", "🙂🚀👩‍👩‍👧", "\u0301\u0308\u200d\ufeff\x00\x1f"]
    texts = []
    for _ in range(300):
        letters = list("".join(rng.choice(pools, rng.integers(1, 5))))
        texts.append("".join(rng.choice(letters, rng.integers(1, 60))))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.pack(d, **tokenizer_files()).toPandas(), list(enumerate(texts)))


def test_pack_encodes_the_distinct_chunks_of_a_batch_together():
    """The vocabulary is asked once a batch, not once a chunk; texts with other blanks keep the tokenizer's ids."""
    import pyarrow as pa

    enc = packing.Encoder(**tokenizer_files())
    texts = ["\n".join(f"word{i} w{i * 7} x{i}" for i in range(1500)), "alpha beta\ngamma", None, "", " lead", "a\n\nb", "word1 <|endoftext|>", "x\x1c y", "alpha beta\ngamma"]
    want = [np.array(enc.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    calls, ranks = [], enc.by_rank

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return ranks.encode_ordinary(text)

    enc.by_rank = Counted()
    assert list(enc(pa.array(texts))) == want and len(calls) == 1


# op10 ---------------------------------------------------------------------------------------------------------------------

def test_base_score_equals_brute_force_and_ppm_learns(spark, tiny, docs):
    got = QUERIES["op10_ppm"](spark, tiny).toPandas().set_index("doc_id")
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs.doc_id}
    toks = {i: [*words(t), None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    c = collections.Counter(x for i, w in toks.items() if fold[i] != 1 for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in toks.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i] == 1, len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    size = {i: len((t or "").encode()) + 1 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    held = got[got.held_out]
    assert held.score.sum() / sum(size[i] for i in held.index) > -1.3  # uniform bytes cost 2.41


def ppm(train, text, order):
    """log10 of the probability of ``text`` and its end: PPM with method C and exclusion, by counting in lists."""
    after = collections.defaultdict(collections.Counter)
    run = lambda t: ["^"] * order + list(t.translate(LOWER)) + ["$"]
    for t in train:
        x = run(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                after[tuple(x[i - k : i])][x[i]] += 1
    total, x = 0.0, run(text)
    for i in range(order, len(x)):
        refused = set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in after.get(tuple(x[i - k : i]), {}).items() if s not in refused}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if x[i] in left:
                total += math.log10(left[x[i]] / whole)
                break
            total += math.log10(len(left) / whole)
            refused |= set(left)
        else:
            total -= math.log10(257 - len(refused))
    return total


@pytest.mark.parametrize("head", [1 << 20, 3])
def test_scores_equal_ppm_by_counting(spark, monkeypatch, head):
    """Whole scores, with all strings broadcast and with nearly all joined."""
    monkeypatch.setattr(scoring, "HEAD", head)
    monkeypatch.setattr(scoring, "TRIE_ROWS", 50)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abcB "), rng.integers(0, 60)).tolist()).decode() for _ in range(60)] + ["zq abc", "aaaaaaaaaaaaaaaaaaaaaaaa", "", "é abc"]
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))]
    train = [t.encode() for i, t in enumerate(texts) if fold[i] != 1]
    got = {r.doc_id: r.score for r in scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], ppm(train, t.encode(), scoring.ORDER), rel_tol=1e-5, abs_tol=1e-5), (i, t)


def test_chain_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 120).astype(np.uint8)
    g = scoring.ngrams(scoring.symbols(data, np.array([0, 50, 120]), scoring.ORDER)[0], scoring.ORDER)
    levels = [np.unique(g & scoring._mask(k + 1), return_counts=True) for k in range(scoring.ORDER + 1)]
    levels = [(k, n.astype(float)) for k, n in levels]
    symbols = np.append(np.arange(256), scoring.END)
    for context in [*rng.choice(g, 5), 0]:
        assert math.isclose((10 ** scoring.chain(levels, (context >> scoring.BITS << scoring.BITS) | symbols)).sum(), 1, rel_tol=1e-9)


def test_scores_odd(odd_docs, no_docs):
    got = scoring.score(odd_docs).toPandas()
    assert len(got) == odd_docs.count() and np.isfinite(got.score).all() and np.isfinite(got.base_score).all()
    assert scoring.score(no_docs).count() == 0


# pipeline -----------------------------------------------------------------------------------------------------------------

def test_pipeline_of_empty_and_awkward_tables(spark, tiny, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (no_docs, odd_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, tiny)
            assert docs.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() >= docs.count()


def test_pipeline_stages(spark, tiny, odd_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny).cache()
        assert docs.columns == columns, name
    assert docs.count() > 0
    packed = corpus_pipeline.run(spark, tiny)
    kept = docs.select("doc_id").distinct().count()
    assert packed.select("doc_id").distinct().count() == kept


def test_many_equal_rows_cost_no_more_each(spark):
    """Rows that are equal in id and text share one key; their spans and segments are held once."""
    text = " ".join(f"t{i * 7919 % 9973}" for i in range(900))
    took = {}
    for n in (200, 2000):
        d = spark.createDataFrame([(1, text)] * n + [(2, text[500:1500]), (3, "short")], "doc_id long, text string")
        began = time.time()
        got = substrings.remove_repeats(d).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("least"), F.max("n_removed").alias("most")).collect()
        took[n] = time.time() - began
        assert {r.doc_id: (r.n, r.least, r.most) for r in got} == {1: (n, len(text), len(text)), 2: (1, 1000, 1000), 3: (1, 0, 0)}
    assert took[2000] < 3 * took[200] + 5, took
