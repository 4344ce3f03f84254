"""Cross-entropy differences against plain counting, and on held-out texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import lm_scoring as lm


def plain(docs, good, size, mu):
    words = {k: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] for k, (_, t) in enumerate(docs)}
    freq = Counter(w for x in words.values() for w in x)
    known = {w: i for i, (w, _) in enumerate(sorted(freq.items(), key=lambda x: (-x[1], x[0]))[: size - 1], 1)}
    ids = {k: [known.get(w, size) for w in x] for k, x in words.items()}
    uni, big, ctx, n = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for k, x in ids.items():
        c = 0 if docs[k][0] in good else 1
        n[c] += len(x)
        uni[c].update(x)
        big[c].update(zip([0, *x], x))
        ctx[c].update([0, *x] if x else [])
    scale = [1.0, n[0] / n[1] if n[0] and n[1] else 1.0]
    last = lambda c, v: uni[c][v] if v else sum(1 for k, x in ids.items() if x and (docs[k][0] in good) == (c == 0))
    out = []
    for k, x in ids.items():
        total = 0.0
        for v, w in zip([0, *x], x):
            p = []
            for c in (0, 1):
                pw = (uni[c][w] * scale[c] + 0.5) / (n[c] * scale[c] + 0.5 * size)
                p.append((big[c][v, w] * scale[c] + mu * pw) / (last(c, v) * scale[c] + mu))
            total += math.log(p[1]) - math.log(p[0])
        out.append((docs[k][0], len(x), total / len(x) if x else None))
    return out


def test_against_plain_counts(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice(["", "x", "Y"]) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    docs += [(100, ""), (101, None), (None, "a b c"), (3, docs[3][1]), (200, "zz " * 5000)]
    good = {i for i in range(0, 80, 3)}
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, SCORE string")
    g = spark.createDataFrame([(i,) for i in [*good, 3, 9999]], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([tuple(r) for r in lm.cross_entropy_difference(df, g, head_words=8).collect()], key=key)
    want = sorted(plain(docs, good, lm.VOCABULARY, lm.MU), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2] == (None if b[2] is None else pytest.approx(b[2], abs=1e-9))


def test_held_out_texts_and_empty(spark):
    rng = random.Random(8)
    vocab = {c: [c + "".join(rng.choice("aeiou") for _ in range(3)) for _ in range(60)] for c in "kt"}
    text = lambda c: " ".join(rng.choice(vocab[c] if rng.random() < 0.6 else vocab["k"] + vocab["t"]) for _ in range(80))
    docs = [(i, text("k" if i % 2 else "t")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(1, 200, 2)], "doc_id long")
    score = {r.doc_id: r.score for r in lm.cross_entropy_difference(df, good).collect()}
    wins = [score[a] < score[b] for a in range(201, 300, 2) for b in range(200, 300, 2)]
    assert sum(wins) / len(wins) > 0.9
    assert lm.cross_entropy_difference(df.limit(0), good).count() == 0


def test_rare_words_keep_their_own_counts(spark):
    docs = [(0, " ".join(f"w{k} w{k}" for k in range(lm.VOCABULARY + 500))), (1, "rare_a rare_b"), (2, "rare_c rare_d"), (3, "rare_a rare_b"), (4, "w1 rare_c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(df, spark.createDataFrame([(1,)], "doc_id long")).collect()}
    want = {r[0]: r for r in plain(docs, {1}, lm.VOCABULARY + 504, lm.MU)}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r.n_tokens == want[i][1] and r.score == pytest.approx(want[i][2], abs=1e-9)


def test_a_bigram_of_all_documents_comes_once_per_chunk():
    class Known:
        value = np.zeros(0, np.uint64)

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array(["Rare words"] * 3000)], names=["key", "doc_id", "text"])
    chunks = [pa.RecordBatch.from_arrays([*c.columns, pa.array([[0, 2]])], names=[*c.schema.names, "good"]) for c in lm._chunks(Known)([batch])]
    rows = [r for c in lm._ask(4, 8)(chunks) for r in c.to_pylist()]
    assert len(chunks) == 1 and sum(len(lm.opened(r["keys"])) for r in rows) == 4  # two words, the start's bigram and theirs
    assert sorted(int(n) for r in rows for n in lm.opened(r["t"])) == [2] * 4


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        assert (lm.opened(lm.squeezed(x)) == x).all()
