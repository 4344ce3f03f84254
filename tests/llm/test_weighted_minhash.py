"""Near-duplicates against all pairs' weighted Jaccard similarity, from words and exact counts."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import weighted_minhash as wm

from .test_vector_join import plain


def weighted(docs):
    """Id -> {shingle: weight}, by the definition: tuples of words, exact document frequencies, no hashes."""
    counts = {}
    for i, t in docs:
        words = [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w]
        counts[i] = Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else Counter()
    df = Counter(g for c in counts.values() for g in c)
    n, floor = sum(1 for c in counts.values() if c), max(1, sum(df.values()) / 65536)
    return {i: {g: k * (1 + math.log(n / max(df[g], floor))) for g, k in c.items()} for i, c in counts.items()}


def jaccard(a, b):
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def links(docs, at_least=0.8):
    sets = {i: w for i, w in weighted(docs).items() if w}
    ids, where = list(sets), {}
    for i, w in sets.items():
        for g in w:
            where.setdefault(g, []).append(i)
    pairs = {(i, j) for own in where.values() if len(own) > 1 for i in own for j in own if i < j}
    return ids, [(i, j) for i, j in sorted(pairs) if jaccard(sets[i], sets[j]) >= at_least]


def word(rng, k=4):
    return "".join(rng.choice("abcdefgh") for _ in range(k))


def test_sampling_follows_similarity():
    rng = np.random.default_rng(0)
    same, want = [], []
    for _ in range(60):
        s = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        w = rng.integers(1, 4, len(s)).astype(float)
        v = np.where(rng.random(len(s)) < 0.3, 0, w + (rng.random(len(s)) < 0.2))
        same.append((wm.sample(s, w) == wm.sample(s[v > 0], v[v > 0])).mean())
        want.append(wm.similarity(s, w, s[v > 0], v[v > 0]))
    assert abs(np.mean(same) - np.mean(want)) < 0.02


def test_samples_by_the_formula_and_in_arrays_used_again():
    r_of, c_of, seeds = wm.draws()
    rng = np.random.default_rng(2)
    for n in (1, 7, wm.PIECE, 3 * wm.PIECE + 1):
        s, w = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), rng.integers(1, 9, n) * 1.5
        want = []
        for seed in seeds:
            x = s + seed
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            r, c = r_of[x & np.uint64(0xFFFF)], c_of[(x >> np.uint64(16)) & np.uint64(0xFFFF)]
            beta = (x >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(np.log(w).astype(np.float32) * (np.float32(1) / r) + beta)
            k = (r * (beta - t - 1) + c).argmin()
            want.append(wm.mixed(s[k : k + 1] + np.uint64(int(t[k]) % 2**64) * np.uint64(0xFF51AFD7ED558CCD))[0])
        assert wm.sample(s, w).tolist() == want
    tracemalloc.start()
    try:
        wm.sample(s, w)
        assert tracemalloc.get_traced_memory()[1] < 300_000  # no new arrays of PIECE shingles by all samples
    finally:
        tracemalloc.stop()


def test_bins_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 50, 5000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        w, v = rng.random(len(s)) * 20, rng.random(len(s)) * 20
        a, b = (np.frombuffer(wm.bins(s, x), np.float16).astype(float) for x in (w, v))
        assert np.minimum(a, b).sum() >= np.minimum(w, v).sum()


@pytest.mark.parametrize("small", [16, 3])
def test_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(wm, "SMALL", small)
    rng = random.Random(small)
    docs = []
    for g in range(12):
        base = [word(rng) for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                t[rng.randrange(len(t))] = word(rng)
            docs.append(" ".join(t))
    docs += [docs[0].upper(), docs[0].replace(" ", "\n "), "", None, "  ", "one two", "One  two", "three", docs[3] + " " + docs[4]]
    docs += [" ".join(word(rng) for _ in range(60_000))] * 2  # very long, with a near copy
    docs[-1] += " and so on"
    rows = list(enumerate(docs))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, Kept string")
    got = {r.doc_id: r for r in wm.near_duplicates(df).collect()}
    want = plain(list(range(len(docs))), links(rows)[1])
    wrong = [i for i in want if got[i].component_id != want[i]]
    assert len(got) == len(rows) and not wrong
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "x y"), (5, "x y"), (5, "X z q"), (None, None), (7, "A b C d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text, r.component_id, r.kept) for r in wm.near_duplicates(df).collect())
    assert got == {(None, "a b c d e f", 7, False): 2, (5, "x y", 5, True): 2, (5, "X z q", 5, True): 1, (None, None, None, True): 1, (7, "A b C d e f", 7, True): 1}
    assert wm.near_duplicates(df.limit(0)).count() == 0


def test_recall_in_crowded_buckets(spark, monkeypatch):
    """Many texts around one passage, similar in pairs only: recall over all pairs of similarity 0.8 or more."""
    monkeypatch.setattr(wm, "SMALL", 3)
    monkeypatch.setattr(wm, "BLOCK", 50)
    rng = random.Random(11)
    passage = [word(rng, 8) for _ in range(300)]
    docs = []
    for _ in range(120):
        both = [word(rng, 8) for _ in range(rng.choice([40, 120, 200]))]
        docs += [" ".join(passage[: rng.choice([200, 300])] + both + [word(rng, 8) for _ in range(rng.choice([1, 4, 12]))]) for _ in range(2)]
    rows = list(enumerate(docs))
    _, near = links(rows)
    got = {r.doc_id: r.component_id for r in wm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[i] == got[j] for i, j in near)
    want = plain(list(got), near)
    assert len(near) > 50 and found >= 0.95 * len(near)
    assert all(want[i] == want[got[i]] for i in got)


def test_recall_on_the_test_table(spark, small):
    """Recall over the pairs of similarity 0.8 or more of a given table, found through all shared shingles; and no false group."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, near = links(rows)
    got = {r.doc_id: r.component_id for r in wm.near_duplicates(docs).collect()}
    found = sum(got[i] == got[j] for i, j in near)
    want = plain(list(got), near)
    assert near and found >= 0.98 * len(near)
    assert all(want[i] == want[got[i]] for i in got)
