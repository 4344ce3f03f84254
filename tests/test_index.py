"""The knowledge index: embedder, commits of whole projects, failures, other dimensions."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.sources import index, shared

SCHEMA = "id string, text string, source_type string, project_id string, metadata_json string, vector array<float>"


def chunks(spark, projects, size=3, word="text"):
    return spark.createDataFrame([(f"{p}-{k}", f"{word} {k}", "note", p, "{}", [1.0] * size) for p in projects for k in range(2)], SCHEMA)


def stored(spark, path, projects=None):
    return sorted((r.project_id, r.text) for r in index.chunks_of(spark, path, projects).collect())


def named(spark, *projects):
    return spark.createDataFrame([(p,) for p in projects], "project_id string")


def test_hashed_grams_are_counts_with_signs():
    model = index.HashedGrams(64)
    got = model.encode(["ab", "", "ab", "注释"])
    raw = np.zeros(64)
    for gram in ("a", "b", "ab"):
        h = len(gram) + sum(31**k * ord(c) for k, c in enumerate(gram))
        raw[h % 64] += 1 if h % 8191 % 2 == 0 else -1
    assert np.allclose(got[0], raw / np.linalg.norm(raw)) and (got[0] == got[2]).all() and not got[1].any()
    assert np.isclose(np.linalg.norm(got[3]), 1)


def test_models_are_made_once_and_get_bounded_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    class Model:
        def __init__(self):
            with open(log, "a") as f:
                f.write("made\n")

        def encode(self, texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(i, "x" * (i % 5) if i % 7 else None) for i in range(100)], "i long, text string").coalesce(1)
    got = index.embed(df, Model, "counted", batch=8).collect()
    assert all(list(r.vector) == [len(r.text or ""), 1.0] for r in got) and len(got) == 100
    said = open(log).read().split()
    assert said.count("made") == 1 and max(int(x) for x in said if x != "made") <= 8
    assert index.embed(df.limit(0), Model, "counted").count() == 0


def test_projects_are_replaced_in_one_commit(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert index.chunks_of(spark, path) is None
    index.delete_projects(named(spark, "a"), path)
    index.replace_projects(chunks(spark, "abc"), named(spark, "a", "b", "c"), path, shards=2)
    index.append_chunks(chunks(spark, "d"), path, shards=2)
    assert [p for p, _ in stored(spark, path)] == list("aabbccdd")
    index.replace_projects(chunks(spark, "a", word="new"), named(spark, "a", "b"), path, shards=2)
    assert stored(spark, path) == [("a", "new 0"), ("a", "new 1"), ("c", "text 0"), ("c", "text 1"), ("d", "text 0"), ("d", "text 1")]
    index.delete_projects(named(spark, "a", "c", "d"), path, shards=2)
    assert stored(spark, path) == []
    index.replace_projects(chunks(spark, "e"), named(spark, "e"), path, shards=2)
    assert [p for p, _ in stored(spark, path)] == list("ee")


def test_a_failed_job_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.replace_projects(chunks(spark, "abc"), named(spark, "a", "b", "c"), path)
    bad = chunks(spark, "a").withColumn("text", F.when(F.col("id") == "a-1", F.raise_error(F.lit("broken text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken text"):
        index.replace_projects(bad, named(spark, "a"), path)
    with pytest.raises(Exception, match="broken text"):
        index.append_chunks(bad, path)
    assert [p for p, _ in stored(spark, path)] == list("aabbcc")


def test_other_dimensions_drop_the_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.replace_projects(chunks(spark, "ab"), named(spark, "a", "b"), path)
    index.append_chunks(chunks(spark, "c", size=4), path)
    assert [p for p, _ in stored(spark, path)] == list("cc")
    index.append_chunks(chunks(spark, []), path)  # nothing to add, nothing to drop
    assert [p for p, _ in stored(spark, path)] == list("cc")
    index.replace_projects(chunks(spark, "d", size=5), named(spark, "d"), path)
    assert [p for p, _ in stored(spark, path)] == list("dd")


def test_a_search_reads_the_shards_of_its_projects(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    names = [f"p{k}" for k in range(40)]
    index.replace_projects(chunks(spark, names), named(spark, *names), path)
    one = index.chunks_of(spark, path, ["p7"])
    assert [p for p, _ in sorted((r.project_id, r.text) for r in one.collect())] == ["p7", "p7"]
    assert re.search(r"PartitionFilters: \[[^]]*shard", one._jdf.queryExecution().executedPlan().toString())


def test_chunks_that_stay_are_not_shuffled(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    names = [f"p{k}" for k in range(200)]
    noise = F.concat_ws("", *[F.sha2(F.concat("id", F.lit(str(k))), 512) for k in range(80)])  # 10,240 letters
    index.replace_projects(chunks(spark, names).withColumn("text", noise), named(spark, *names), path)

    def shuffled():
        bus = spark.sparkContext._jsc.sc()
        bus.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        return bus.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    index.replace_projects(chunks(spark, names[:3], word="new"), named(spark, *names[:3]), path)
    assert shuffled() - before < 400_000  # of 4,096,000 letters
    got = stored(spark, path)
    assert [p for p, _ in got] == sorted(2 * names) and [t for p, t in got if p in names[:3]] == ["new 0", "new 1"] * 3


def test_chunks_that_the_filter_takes_for_gone_ones_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "BITS", 8)
    monkeypatch.setattr(shared, "SLOT", 8)
    path = f"file://{tmp_path}/index"
    names = [f"p{k}" for k in range(60)]
    index.replace_projects(chunks(spark, names), named(spark, *names), path, shards=3)
    index.delete_projects(named(spark, *names[::2], "unknown"), path, shards=3)
    assert [p for p, _ in stored(spark, path)] == sorted(2 * names[1::2])


def test_settings_are_put_back(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    keys = [*index._SMALL_FILES, *index._NO_REMAINS]
    was = [spark.conf.get(k) for k in keys]
    for p in ("a", "b"):
        index.replace_projects(chunks(spark, p), named(spark, "a"), path)
    index.append_chunks(chunks(spark, "c"), path)
    assert [spark.conf.get(k) for k in keys] == was
