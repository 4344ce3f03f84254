"""Folds by blocks against the plain folds, and a long meeting over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import blocks, ordered


def plain(rows):
    """The plain fold over (t, a, r) rows."""
    return blocks.numbered(*map(list, zip(*rows)), None, 0) if rows else []


def cut(values, rng):
    at = sorted(rng.sample(range(1, len(values)), min(rng.randint(0, 6), len(values) - 1))) if len(values) > 1 else []
    return [values[a:b] for a, b in zip([0, *at], [*at, len(values)])]


@pytest.mark.parametrize("kind", ["pack", "mark", "speech", "time", "any"])
def test_tables_compose_to_the_plain_fold(kind):
    rng = random.Random(kind)
    for _ in range(150):
        n, rows, clock = rng.randint(1, 60), [], 0.0
        for _ in range(n):
            if kind == "pack":
                k = rng.randint(0, 40)
                rows.append((60 - 1 - k + 1, k + 1, k))
            elif kind == "mark":
                rows.append((2 if rng.random() < 0.4 else blocks.NEVER, 1, 1))
            elif kind == "speech":
                d = rng.choice([0, 1, 3, 7, -1])
                rows.append((5 if rng.random() < 0.3 else 20, d, d))
            elif kind == "time":
                clock += rng.randint(0, 30)
                rows.append((100 - clock - rng.randint(0, 40) + 1, 0, -clock))
            else:
                rows.append((rng.choice([rng.randint(-9, 30), blocks.NEVER]), rng.randint(-5, 9), rng.randint(-5, 9)))
        low = {"pack": lambda x: 0.0, "mark": lambda x: 1.0, "time": lambda x: x[0][2]}.get(kind, lambda x: -blocks.NEVER)
        parts = cut(rows, rng)
        tables = []
        for k, x in enumerate(parts):
            names = ("at", "cuts", "leaves", "total", "first_cuts", "first_leaves")
            tables.append({"block": k} | dict(zip(names, blocks.block_table(*map(list, zip(*x)), low(x)))))
        got = [p for (_, number, part), x in zip(blocks.through(tables), parts) for p in blocks.numbered(*map(list, zip(*x)), number, part)]
        assert got == plain(rows)


def reference(spark, rows, fold, **keys):
    return {(k, i): v for k, own in rows.items() for i, v in enumerate(fold(own))}


def test_columns_equal_the_plain_folds(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 7)
    rng = random.Random(2)
    meetings = {f"m{k}": [("x" * rng.randint(0, 30), rng.random() < 0.2, float(4 * i), 4.0 * i + rng.choice([1, 3, 30])) for i in range(rng.choice([1, 2, 40, 300]))] for k in range(12)}
    rows = [(k, i, t, m, s, e, None) for k, own in meetings.items() for i, (t, m, s, e) in enumerate(own)]
    df = spark.createDataFrame(rows, "p string, idx long, text string, marked boolean, start double, end double, odd string").repartition(5)
    got = {(r.p, r.idx): r.chunk for r in blocks.packed(df, ["p"], ["idx"], F.length("text"), 50).collect()}
    assert got == {(k, i): c for k, own in meetings.items() for i, c in enumerate(ordered.pack_lines([len(t) for t, *_ in own], 50))}
    for mode in ("semantic", "hybrid"):
        gap = F.coalesce(F.col("start") - F.lag("end").over(blocks.Window.partitionBy("p").orderBy("idx")) > 1.5, F.lit(False))
        got = {(r.p, r.idx): r.paragraph for r in blocks.paragraphs(df, ["p"], ["idx"], F.col("marked"), mode, gap=gap).collect()}
        want = {(k, i): c for k, own in meetings.items() for i, c in enumerate(ordered.paragraphs([s for _, _, s, _ in own], [e for *_, e in own], ["mark" if m else "" for _, m, *_ in own], ("mark",), mode))}
        assert got == want
    got = blocks.recording_windows(df, ["p"], ["idx"], 60.0)
    assert {(r.p, r.idx): r.window for r in got.collect()} == {(k, i): c for k, own in meetings.items() for i, c in enumerate(ordered.aligner_windows([s for _, _, s, _ in own], [e for *_, e in own], 60.0))}
    assert blocks.packed(df.limit(0), ["p"], ["idx"], F.length("text"), 50).count() == 0
    nulls = spark.createDataFrame([(None, 1, None), (None, 2, "b"), ("p", 1, "c")], "p string, idx long, text string")
    assert sorted((r.p or "", r.idx, r.chunk) for r in blocks.packed(nulls, ["p"], ["idx"], F.length(F.coalesce("text", F.lit(""))), 0).collect()) == [("", 1, 0), ("", 2, 1), ("p", 1, 0)]


def test_runs_of_like_texts_equal_the_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 5)
    rng = random.Random(8)
    kinds = ["abcde", "abcdx", "abcxy", "", "zzz", "zzzz", "abxyz"]
    meetings = {f"m{k}": [rng.choice(kinds) for _ in range(rng.choice([1, 3, 60]))] for k in range(10)} | {"same": ["abcde"] * 50, "none": [""] * 20, "turns": ["abcde", "abcdx", "abcxy", "abxyz"] * 10}
    df = spark.createDataFrame([(k, i, t or None) for k, own in meetings.items() for i, t in enumerate(own)], "p string, idx long, text string").repartition(3)
    got = {(r.p, r.idx): r.repeated for r in blocks.repeated(df, ["p"], "idx", F.col("text"), ordered.char_similarity, 0.6, 3).collect()}
    assert got == {(k, i): f for k, own in meetings.items() for i, f in enumerate(ordered.repeated_runs(own, ordered.char_similarity, 0.6, 3))}


def test_one_long_meeting_is_many_tasks(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("p").alias("p"), F.col("id").alias("idx"), (F.col("id") % 37).cast("int").alias("size"))
    done = blocks.packed(rows, ["p"], ["idx"], F.col("size"), 500)
    want = ordered.pack_lines([i % 37 for i in range(n)], 500)
    got = done.select("idx", "chunk", F.spark_partition_id().alias("task")).toPandas().sort_values("idx")
    assert got["chunk"].tolist() == want and got["task"].nunique() > 1
    plan = done._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Window" not in plan
