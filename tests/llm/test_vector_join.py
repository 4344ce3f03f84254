"""The range join against brute force, and components against a plain search."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import vector_join
from colloquy.llm.components import components


def plain(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain({x for e in edges for x in e}, edges)
    assert got == {k: want[k] for k in got} and all(k in got for e in edges for k in e if e[0] != e[1])


def brute(rows, cosine=0.98):
    ok = {i: np.array(v, float) for i, v, lab, *_ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v, float) != 0)}
    lab = {i: r[2] for r in rows for i in [r[0]]}
    ids = sorted(ok)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if lab[a] == lab[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine]
    comp = plain([r[0] for r in rows], edges)
    links = {r[0]: 0 for r in rows}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    return sorted((i, links[i], comp[i], comp[i] == i) for i in links)


def compare(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, N_Links string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_join.near_vectors(df).collect())
    f = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got == brute(f)


@pytest.mark.parametrize("cell", [1024, 20])
def test_range_join(spark, monkeypatch, cell):
    monkeypatch.setattr(vector_join, "CELL", cell)
    monkeypatch.setattr(vector_join, "BLOCK", cell)
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.3])).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [None] * 8, 1), (2003, [float("nan")] * 8, 1), (2004, [1.0] * 8, None), (2005, [1.0] * 8, None), (2006, [1.0] * 3, 1), (2007, [2.0] * 3, 1), (2008, [], 1), (2009, [float("inf")] * 8, 0)]
    compare(spark, rows)


def test_empty(spark):
    assert vector_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_one_id_on_two_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a"), (4, [0.0, 1.0], "a"), (0, [-1.0, 0.0], "a")]
    got = sorted((r.vec_id, tuple(r.embedding), r.n_links, r.component_id, r.kept) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(0, (-1.0, 0.0), 0, 0, True), (1, (0.0, 1.0), 2, 1, True), (1, (1.0, 0.0), 1, 1, True), (2, (1.0, 0.01), 1, 1, False), (3, (0.01, 1.0), 2, 1, False), (4, (0.0, 1.0), 2, 1, False)]


def test_tables_written_grow_with_the_vectors_alone(spark, monkeypatch):
    """Vectors in 64 dimensions lie near most borders of 63 cells; none may be copied for each."""
    monkeypatch.setattr(vector_join, "CELL", 64)
    monkeypatch.setattr(vector_join, "BLOCK", 64)
    sizes, write = [], vector_join.materialize

    def measured(df, *args, **kwargs):
        table = write(df, *args, **kwargs)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles()))
        return table

    monkeypatch.setattr(vector_join, "materialize", measured)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 64)).astype(np.float32)
    v[3000:] = v[:1000] + rng.normal(size=(1000, 64)).astype(np.float32) * 0.1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(4)
    got = {r.vec_id: r.n_links for r in vector_join.near_vectors(df).select("vec_id", "n_links").collect()}
    assert sum(sizes) < 3 * v.nbytes
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert got == dict(enumerate(want)) and want.sum() > 500


def test_crowds_and_double_vectors(spark, monkeypatch):
    """Blocks in which all vectors are near, a chain through many blocks, and cosines within single precision's error of the threshold."""
    monkeypatch.setattr(vector_join, "CELL", 30)
    monkeypatch.setattr(vector_join, "BLOCK", 30)
    turn = np.arccos(0.98)
    chain = [(k, [float(np.cos(k * turn * (1 - 1e-9))), float(np.sin(k * turn * (1 - 1e-9)))], "a") for k in range(30)]
    apart = [(100 + k, [float(np.cos(k * turn * (1 + 1e-9))), float(np.sin(k * turn * (1 + 1e-9))), 0.0], "a") for k in range(30)]
    rng = np.random.default_rng(9)
    crowd = [(200 + k, (np.ones(8) + rng.normal(size=8) * 0.01).tolist(), "b") for k in range(200)]
    rows = chain + apart + crowd + crowd[:5]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert [got[k] for k in range(30)] == [(1 if k in (0, 29) else 2, 0) for k in range(30)]
    assert [got[100 + k] for k in range(30)] == [(0, 100 + k) for k in range(30)]
    assert all(got[200 + k] == (204, 200) for k in range(200))
