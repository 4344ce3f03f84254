"""Mixture weights against a plain bisection, and the pipeline against its stages' brute-force versions."""

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from colloquy.llm import mixing

from .test_text_operators import base_spans


def exponent(tokens, entropy, repeats):
    p = [t / sum(tokens) for t in tokens]

    def good(a):
        w = [x**a for x in p]
        z = sum(w)
        h = -sum(x / z * math.log(x / z) for x in w)
        return h <= entropy * math.log(len(p)) + 1e-12 and (max(p) / min(p)) ** (1 - a) <= repeats

    low, high = 0.0, 1.0
    if good(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


@pytest.mark.parametrize("entropy,repeats", [(0.9, 100.0), (0.999, 3.0), (1.0, 1e9)])
def test_weights_and_copies(spark, entropy, repeats):
    rows = [(i, "w " * (5 + i % 7), s) for s, n in (("a", 400), ("b", 90), ("c", 40), (None, 25)) for i in range(n)]
    rows = [(i, t, s, "clash") for i, (_, t, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Copies string")
    got = mixing.mix(df, entropy=entropy, repeats=repeats).collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    a = exponent(list(tokens.values()), entropy, repeats)
    z = sum((t / sum(tokens.values())) ** a for t in tokens.values())
    taken = Counter()
    for r in got:
        assert r.mix_weight == pytest.approx((tokens[r.source] / sum(tokens.values())) ** a / z, rel=1e-4)
        assert 1 <= r.copies <= repeats + 1e-3 or r.copies == math.ceil(r.mix_epochs)
        taken[r.source] += r.copies * r.n_tokens
    for s, n in taken.items():
        want = {r.source: r.mix_epochs for r in got}[s] * tokens[s]
        assert abs(n - want) <= 12  # half a block, which is a document here
    assert len(got) == len(rows)
    assert mixing.realise(mixing.mix(df, entropy=entropy, repeats=repeats)).count() == sum(r.copies for r in got)


def test_columns_named_like_inner_ones_stay(spark):
    df = spark.createDataFrame([(1, "x y", "a", "b", "w", "c")], "doc_id long, text string, source string, blocks string, whole string, cutoff string")
    got = mixing.mix(df).first()
    assert (got.blocks, got.whole, got.cutoff) == ("b", "w", "c")


def test_budget_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", None), (3, "x y z", "c"), (3, "x y z", "c")], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 5 and mixing.mix(df.limit(0)).count() == 0
    assert all(r.copies >= 1 for r in mixing.mix(df).collect())
    assert sum(r.copies * r.n_tokens for r in mixing.mix(df, budget=1).collect()) <= 4


def test_pipeline(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    stage = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, stage, small)
    assert all(len(r.text.split()) >= 50 for r in kept.collect())
    one = corpus_pipeline.near_dedup(spark, kept, small)
    assert {r.doc_id for r in one.collect()} <= {r.doc_id for r in kept.collect()}
    texts = Counter(" ".join(r.text.lower().split()) for r in one.collect())
    assert max(texts.values()) == 1
    clean = {r.doc_id: r for r in corpus_pipeline.secrets(spark, one, small).collect()}
    for r in one.collect():
        for a, _, _, b in base_spans(r.text):
            assert r.text[a:b] not in clean[r.doc_id].text
        if clean[r.doc_id].text == r.text:
            assert clean[r.doc_id].n_chars == r.n_chars
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} == set(clean)
    for r in out:
        assert hashlib.sha256(clean[r.doc_id].text.encode()).hexdigest() == r.decoded_sha256
    assert len(docs) >= len(clean) > 0.5 * len(docs)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, COPIES string, n_tokens string, blocks string"


def odd_documents(spark):
    prose = " ".join(f"word{k} thing{k * 7 % 101}" for k in range(60))
    texts = [None, "", " \n", prose, prose, prose + " end", prose.upper(), prose.replace("word3 ", "word3 token=abcdef123456 "), "long " + " ".join(f"w{k}" for k in range(200_000)), "same same same " * 40]
    rows = [(k if k % 5 else None, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", None if k % 2 else 7, "x", "x", "x", "x") for k, t in enumerate(texts)]
    rows += [rows[3], (3, prose, "en", "s1", 7, "x", "x", "x", "x"), (None,) * 9]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, small, name, stage):
    docs = odd_documents(spark)
    got = stage(spark, docs, small)
    if stage is not corpus_pipeline.pieces:
        assert got.columns == corpus_pipeline.COLUMNS
    rows = got.collect()
    if stage is corpus_pipeline.quality_rules:
        assert rows and all(r.text and len(r.text.split()) >= 50 for r in rows) and not any(r.text.startswith("same") for r in rows)
    elif stage is corpus_pipeline.near_dedup:
        assert Counter(r.text for r in rows)[None] == 2 and {r.doc_id for r in rows if "word7" in (r.text or "").lower()} <= {3, 7}  # rows that repeat id and text stay together
    elif stage is corpus_pipeline.secrets:
        assert len(rows) == docs.count() and not any("abcdef123456" in (r.text or "") for r in rows)
    elif stage is corpus_pipeline.mixture:
        assert {r.text for r in rows} == {r.text for r in docs.collect()} and docs.count() <= len(rows) <= 2 * docs.count()
    else:
        assert len(rows) == docs.count() and all(r.n_tokens == len(r.piece_ids) and r.piece_ids[-1] == 2 for r in rows)
    assert stage(spark, docs.limit(0), small).count() == 0
