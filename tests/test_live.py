"""Streams: a restart goes on where it was, a replayed batch changes nothing, voices end by silence or by timer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import vectors
from colloquy.streaming import live


def events(spark, rows):
    return spark.createDataFrame(rows, "user long, sec double, event long").select("user", F.timestamp_seconds("sec").alias("at"), "event")


def test_a_restarted_stream_and_a_replayed_batch(spark, tmp_path):
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    events(spark, [(1, 0.0, 1), (1, 30.0, 2), (2, 10.0, 3)]).write.parquet(folder)
    stream = lambda: live.sliding(spark.readStream.schema("user long, at timestamp, event long").parquet(folder), ["user"], "at", "1 minute", "1 minute", "0 seconds", F.count("*").alias("n"))
    assert live.run(stream(), out, cp).count() == 0  # no window is over
    events(spark, [(1, 59.0, 4), (1, 90.0, 5)]).write.mode("append").parquet(folder)
    got = sorted((r.user, r.n) for r in live.run(stream(), out, cp).collect())
    assert got == [(1, 3), (2, 1)]
    assert sorted((r.user, r.n) for r in live.run(stream(), out, cp).collect()) == got  # nothing new
    store = live.store_batch(str(tmp_path / "replayed"))
    rows = spark.range(5)
    for batch in (0, 1, 0, 1, 1):
        store(rows, batch)
    assert spark.read.schema("id long").parquet(str(tmp_path / "replayed")).count() == 10


def test_voices_end_by_silence_and_by_timer(spark, tmp_path):
    rows = [(1, 1.0, 1, [3.0, 4.0]), (1, 5.0, 2, [4.0, 3.0]), (2, 6.0, 3, [1.0, 0.0]), (1, 50.0, 4, [1.0, 0.0]), (3, 500.0, 5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "user long, sec double, sample long, v array<double>").select("user", F.timestamp_seconds("sec").alias("at"), "sample", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    own = spark.conf.get(live.PROVIDER, None)
    with live.rocks(spark):
        got = live.run(live.voices(stream, "user", "at", "sample", "v", 10), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert spark.conf.get(live.PROVIDER, None) == own
    found = {(r.key, r.began_ms): (r.last_ms, r.n, r.voice) for r in got}
    assert set(found) == {(1, 1000), (1, 50_000), (2, 6000)}  # user 3 still speaks
    mean = np.array([0.6, 0.8]) / 2 + np.array([4.0, 3.0]) / 2
    assert found[1, 1000][:2] == (5000, 2) and found[1, 1000][2] == pytest.approx((mean / np.linalg.norm(mean)).tolist())


def test_blended_equals_the_column_function(spark):
    rng = np.random.default_rng(1)
    for count in (1, 7, 20, 99):
        a, b = rng.normal(size=(2, 4))
        a /= np.linalg.norm(a)
        row = spark.range(1).select(vectors.blend(F.array(*map(F.lit, a.tolist())), F.lit(count), F.array(*map(F.lit, b.tolist()))).alias("v")).first()
        v, n = live.blended(a, count, b)
        assert v.tolist() == pytest.approx(row.v) and n == min(count + 1, 100)
    assert live.blended(None, 5, np.array([0.0, 2.0]))[1] == 1
