"""Repeated windows against a brute-force search."""

import hashlib
import random
from collections import Counter

import pytest

from colloquy.llm import suffix_dedup


def brute(texts, threshold):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + threshold] for d in data for i in range(len(d) - threshold + 1))
    for d in data:
        mask = bytearray(len(d))
        for i in range(len(d) - threshold + 1):
            if seen[d[i : i + threshold]] > 1:
                mask[i : i + threshold] = b"\x01" * threshold
        runs = sum(mask[i] and not (i and mask[i - 1]) for i in range(len(d)))
        yield len(d), sum(mask), runs, hashlib.sha256(bytes(b for b, m in zip(d, mask) if not m)).hexdigest()


def compare(spark, texts, threshold):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("doc_id", "id")
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, threshold).collect())
    assert got == [(i, *w) for i, w in enumerate(brute(texts, threshold))]
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.choice([20, 60, 130])) for _ in range(8)]
    texts = [text(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 30) :] + text(rng.randint(0, 50)) + (rng.choice(shared) if rng.random() < 0.5 else "") for _ in range(40)]
    for t in list(texts[:12]):  # near copies
        k = rng.randrange(len(t))
        texts.append(t[:k] + "#" + t[k + 1 :])
    texts += [*texts[:3], "", None, "aaaa" * 200, "ab" * 300 + "x", ("abc " * 150) + ("abc " * 20), "x" * 399, "y" * 400, "z" * 401, "é" * 300]
    compare(spark, texts, 400)


def test_test_data_and_edges(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    got = compare(spark, texts, 400)
    assert sum(g[2] for g in got) > 0
    empty = spark.createDataFrame([], "doc_id long, text string, N_BYTES int")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
