"""Spelling variants against brute force: words and counts by a regular expression, near words by deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from colloquy.llm import queries, spelling  # noqa: E402


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(words):
    """Pairs that share a word with one letter gone, or with a hole in the place of one letter, or one of which is the other with a letter gone."""
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    pairs = {(a, b) for g in holes.values() for a in g for b in g if a != b}
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            if shorter in words:
                pairs |= {(w, shorter), (shorter, w)}
    return pairs


def wanted(docs):
    n = counted(docs)
    by = {w: [] for w in n}
    for a, b in near(n):
        by[a].append(b)
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(by[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def rows(df):
    got = df.select("word", "n", "n_near", "form", "form_n", "root").collect()
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}
    assert len(found) == len(got)
    return found


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = wanted(docs)
    assert len(want) > 500 and sum(v[1] for v in want.values()) > 20
    assert rows(queries.op13_spelling_variants(spark, small)) == want


def test_planted_variants_and_odd_texts(spark):
    rng = random.Random(11)
    text = []
    for k in range(40):  # words that share their first half, and some their last
        base = "segment" + "".join(rng.choice("abcé") for _ in range(4))
        text += [base] * rng.choice([2, 3, 30, 400]) + [base[:-1]] * 2 + ["x" + base] * 2 + [base[:3] + "q" + base[4:]] * rng.choice([2, 25])
    text += ["Straßen-weiß ÀÉÎÕÜÿ×÷ÀÉÎÕÜÿ×÷", "aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa", "chainone " * 2, "chainonee " * 20, "chainoneee " * 200, "chainoneeee " * 2000]
    docs = [(1, " ".join(text[:300])), (2, " ".join(text[300:])), (3, None), (4, ""), (5, "a"), (None, "nullidword " * 70), (2, " ".join(text[300:])), (6, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, WORD string")
    want = wanted(docs)
    assert want["chainone"][4] == "chainoneeee" and want["chainone"][2] == "chainonee"
    assert rows(spelling.variants(df)) == want
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.filter("doc_id in (3, 4)")).count() == 0


def test_crowded_segments_are_cut_finer(spark):
    rng = random.Random(4)
    words = {"common" + "".join(rng.choice("abcdefgh") for _ in range(6)) + "ending" for _ in range(3000)} | {"common" + "".join(rng.choice("abcdefgh") for _ in range(5)) + "ending" for _ in range(1500)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {tuple(sorted(p)) for p in near(words)}
    for few in (2, 16, 10_000):
        got = spelling.near_words(df, few).collect()
        assert len(got) == len(want) and {tuple(sorted(r)) for r in got} == want
