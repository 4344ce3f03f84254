"""Switched steps that fail without loss; recordings as a data source."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import audio, steps
from colloquy.sources import wav


def shout(text):
    if "bad" in text:
        raise ValueError("a bad word")
    return text.upper()


def test_a_step_that_raises_leaves_its_row(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "a bad one"), (3, None)], "k int, text string")
    todo = [steps.Step("punctuation", text=lambda t: t + "."), steps.Step("correction", text=shout)]
    got = {r.k: (r.text, [(e.step, e.message) for e in r.errors]) for r in steps.post_processed(rows, todo).collect()}
    assert got == {1: ("ONE.", []), 2: ("a bad one.", [("correction", "ValueError: a bad word")]), 3: (None, [])}
    off = steps.post_processed(rows, todo, {"correction": False}, engine="whisper").collect()
    assert [(r.k, r.text) for r in off] == [(1, "one"), (2, "a bad one"), (3, None)]
    assert steps.post_processed(rows.limit(0), todo).count() == 0
    with pytest.raises(ValueError, match="no such step: speling"):
        steps.post_processed(rows, todo, {"speling": True})


def test_a_step_on_rows_that_fails_passes_its_input_on(spark):
    rows = spark.createDataFrame([(1, "one"), (2, "two")], "k int, text string")
    broken = lambda df: df.withColumn("text", F.when(F.col("k") == 2, F.raise_error(F.lit("step broke"))).otherwise(F.col("text")))
    todo = [steps.Step("diarization", rows=lambda df: df.withColumn("speaker", F.lit("Speaker 1"))), steps.Step("segmentation", rows=broken), steps.Step("hallucination", rows=lambda df: df.filter("k = 2")), steps.Step("embedding", rows=lambda df: df.select("nothing"))]
    [r] = steps.post_processed(rows, todo).collect()
    assert (r.k, r.text, r.speaker) == (2, "two", "Speaker 1") and [e.step for e in r.errors] == ["segmentation", "embedding"] and "step broke" in r.errors[0].message


def test_recordings_are_read_by_ranges(spark, tmp_path):
    wav.register(spark)
    rng = np.random.default_rng(3)
    long, stereo = rng.uniform(-1, 1, 8000 * 5 + 77), rng.uniform(-1, 1, (8000, 2))
    (tmp_path / "a.wav").write_bytes(wav.pcm_file(long, 8000))
    (tmp_path / "b.wav").write_bytes(wav.pcm_file(stereo.ravel(), 8000, channels=2))
    (tmp_path / "notes.txt").write_text("not a recording")
    for split in (wav.SPLIT, 10_001):
        df = spark.read.format("wav").option("splitBytes", split).load(f"file://{tmp_path}")
        got = {(r.path.rsplit("/", 1)[1], r.block): r for r in df.collect()}
        assert len(got) == 6 + 1 and df.rdd.getNumPartitions() >= (2 if split == wav.SPLIT else 8)
        back = np.concatenate([got["a.wav", k].samples for k in range(6)])
        assert len(back) == len(long) and np.abs(back - long).max() < 1e-4
        assert np.abs(np.array(got["b.wav", 0].samples) - stereo.mean(axis=1)).max() < 1e-4
        assert got["a.wav", 3].start == 3.0 and got["a.wav", 3].rate == 8000
    loud = np.concatenate([np.full(8000, 0.8), np.zeros(16000), np.full(8000, 0.8)]) * np.where(np.arange(32000) % 2, 1, -1)
    (tmp_path / "speech").mkdir()
    (tmp_path / "speech" / "c.wav").write_bytes(wav.pcm_file(loud, 8000))
    frames = spark.read.format("wav").option("blockSeconds", 30).load(f"file://{tmp_path}/speech").select("path", "start", (F.col("start") + F.size("samples") / F.col("rate")).alias("end"), F.col("samples").cast("array<double>").alias("samples"))
    found = audio.speech_regions(frames, ["path"], 8000).orderBy("start").collect()
    assert [(round(r.start, 1), round(r.end, 1)) for r in found] == [(0.0, 1.0), (3.0, 4.0)], found


@pytest.mark.parametrize("bits, code, kind, scale", [(8, 1, "u1", None), (16, 1, "<i2", 32768), (32, 1, "<i4", 2147483648), (32, 3, "<f4", 1)])
def test_formats(bits, code, kind, scale):
    x = np.array([0.5, -0.25, 0.0, -1.0])
    raw = ((x + 1) * 128).astype("u1").tobytes() if bits == 8 else (x * scale).astype(kind).tobytes()
    size = bits // 8
    head = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, code, 1, 100, 100 * size, size, bits) + b"data" + struct.pack("<I", len(raw))
    form = wav.layout(head + raw, len(head) + len(raw))
    assert form["frames"] == 4 and np.allclose(wav.decoded(raw, form), x)


def test_short_and_foreign_files_are_errors(spark, tmp_path):
    wav.register(spark)
    for name, content, says in (("short", b"RIFF", "44 bytes"), ("foreign", b"x" * 100, "RIFF")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.wav").write_bytes(content)
        with pytest.raises(Exception, match=says):
            spark.read.format("wav").load(f"file://{tmp_path}/{name}").collect()
    with pytest.raises(ValueError, match="can't be read"):
        wav.decoded(b"", {"code": 7, "bits": 8, "channels": 1})
