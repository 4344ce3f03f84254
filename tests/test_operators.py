"""Literal cases of the text functions, folds, vectors, sources and the stream, and plain restatements."""

import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import intervals, ordered, relational, vectors
from colloquy.sources import store
from colloquy.streaming import windows


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,given,want",
    [
        (tx.merge_repeats_zh, "一个一个一个", "一个"),
        (tx.merge_repeats_zh, "对对对", "对"),
        (tx.merge_repeats_zh, "我我我我", "我"),
        (tx.merge_repeats_zh, "天天", "天天"),
        (lambda c: tx.merge_repeats_zh(c, 3), "好好", "好好"),
        (tx.merge_repeats_zh, "这个这个这个", "这个"),
        (tx.merge_repeats_en, "the The the cat", "the cat"),
        (tx.merge_repeats_en, "hello world", "hello world"),
        (tx.remove_fillers_zh, "呃，我们今天开会", "我们今天开会"),
        (lambda c: tx.remove_fillers_zh(c, "light"), "今天天气很好", "今天天气很好"),
        (lambda c: tx.clean_spaces(tx.remove_fillers_en(c)), "um, we should uh start", "we should start"),
        (tx.chinese_digits, "123", "一二三"),
        (tx.chinese_digits, "hello", "hello"),
        (tx.comparable, " Hello, World! ", "helloworld"),
        (lambda c: tx.language_switch(c, True), "this is a long english sentence", True),
        (lambda c: tx.language_switch(c, True), "我们用Google云服务器", False),
        (lambda c: tx.low_confidence(c, F.lit(0.05), 0.2), ".", True),
        (lambda c: tx.low_confidence(c, F.lit(0.15), 0.2), "real text here", False),
        (tx.template_phrase, "Thank you for watching", True),
        (tx.template_phrase, "请订阅我的频道", True),
        (tx.route_question, "How many meetings?", "stats"),
        (tx.route_question, "who said that", "speaker"),
        (tx.mime_type, "a.b.PDF", "application/pdf"),
        (tx.mime_type, "noext", "application/octet-stream"),
        (tx.number_issues_zh, "开会1个月", 2),
        (lambda c: tx.language_switch(c, True), "a b c d e f g h i j k l", False),
        (lambda c: tx.language_switch(c, False), "㐀㐁㐂豈𠀀𠀁", True),
        (lambda c: tx.remove_fillers_en(c, middle=False), "Um, uh; so we start", "we start"),
        (lambda c: tx.remove_fillers_en(c, middle=False), "Umbrella, so", "Umbrella, so"),
        (lambda c: tx.remove_fillers_en(c, "light"), "so um we uh huh go", "so  we  go"),
        (lambda c: tx.remove_fillers_zh(c, "medium", True), "嗯，就是我们那个开会", "我们开会"),
        (lambda c: tx.filtered(c, True, "heavy"), "嗯", ""),
        (lambda c: tx.merge_repeats_en(c, 3), "the the cat cat cat", "the the cat"),
        (tx.repetition_density_zh, "对对对好", 0.75),
        (tx.sentences, "你好，我是A. B!", ["你好，", "我是A.", " B!"]),
        (tx.sentences, "好。。", ["好。。"]),
        (tx.sentences, "", [""]),
        (tx.fenced_json, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        (tx.fenced_json, ' {"a": 1} ', '{"a": 1}'),
        (tx.clean_title, ' "季度，预算。" ', "季度预算"),
        (tx.completion, '{"choices": [{"message": {"content": "hi"}}]}', "hi"),
        (tx.completion, 'data: {"choices":[{"delta":{"content":"a"}}]}\ndata: oops\n\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"b"}}]}', "a"),
        (tx.token_budget, "x" * 10_000, 18_000),
        (tx.colour_index, "AB", 3),
        (tx.numbered_lines, "<think>[9] no</think>[0] one\n[1]  two \nnoise", [(0, "one"), (1, "two")]),
    ],
)
def test_text(spark, f, given, want):
    got = one(spark, f(F.col("t")), t=given)
    assert (list(map(tuple, got)) if isinstance(got, list) and got and not isinstance(got[0], str) else got) == want


def test_similarity(spark):
    rng = random.Random(1)
    for a, b in [("", ""), ("a", ""), *(("".join(rng.choices("abc今 ", k=rng.randint(0, 8))), "".join(rng.choices("abc今 ", k=rng.randint(0, 8)))) for _ in range(20))]:
        want = sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b)) if a or b else 1.0
        assert one(spark, tx.char_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_chunks():
    assert tx.chunk_text("Hello world") == ["Hello world"] and tx.chunk_text(" ") == []
    got = tx.chunk_text("This is a sentence. " * 30, 200, 20)
    assert len(got) > 1 and all(got) and max(map(len, got)) <= 200
    with pytest.raises(ValueError):
        tx.chunk_text("x" * 100, 10, 6)


def test_folds():
    assert ordered.paragraphs([0, 1.1, 5], [1, 2, 6], ["a", "b", "另外"], ("另外",), "semantic") == [0, 0, 1]
    assert ordered.paragraphs([0, 1.1], [1, 2], ["另外", "另外"], ("另外",), "semantic") == [0, 0]
    assert ordered.paragraphs([0, 10.1, 25], [10, 20, 30], ["a", "b", "c"], (), "hybrid") == [0, 0, 1]
    assert ordered.paragraphs([0, 5], [1, 6], ["a", "另外"], ("另外",), "hybrid") == [0, 0]
    runs = lambda *texts: ordered.repeated_runs(list(texts), ordered.char_similarity, 0.6, 3)
    assert runs(*["开会讨论"] * 3, "下一个议题") == [False, True, True, False]
    assert runs("今天讨论项目进展", "明天讨论技术方案") == [False, False] and runs("", "", "") == [False] * 3
    assert runs("abcde", "abcdx", "abcxy") == [False, True, True]  # each like the first, not like each other
    assert ordered.pack_lines([3, 3, 3, 20, 1], 7) == [0, 0, 1, 2, 3]


def speaker_at(turns, t):
    """The rule of a sorted timeline, restated: the latest holding turn, else the nearer of the two around t."""
    turns = sorted(turns, key=lambda u: u[1])
    at = sum(u[1] <= t for u in turns)
    for u in reversed(turns[:at]):
        if u[1] <= t <= u[2]:
            return u[4]
    near = [(min(abs(t - u[1]), abs(t - u[2])), k, u[4]) for k, u in enumerate(turns[max(at - 1, 0) : at + 1])]
    return min(near)[2] if near else None


def test_turns_and_interpolation(spark):
    rng = random.Random(3)
    turns = [(m, float(s), float(s + rng.choice([1, 3, 8])), p, f"s{p % 4}") for m in (1, 2) for p, s in enumerate(sorted(rng.randint(0, 40) for _ in range(8)))]
    turns += [(4, 0.0, 10.0, 0, "A"), (4, 5.0, 6.0, 1, "B"), (4, 20.0, 21.0, 2, "C")]
    points = [(m, i, i * 1.5 - 3) for m in (1, 2, 3) for i in range(35)] + [(4, 0, 10.5), (4, 1, 5.5), (4, 2, 7.0), (4, 3, 99.0)]
    t = spark.createDataFrame(turns, "m long, start double, end double, pos long, speaker string")
    p = spark.createDataFrame(points, "m long, idx long, t double")
    got = {(r.m, r.idx): r.speaker for r in intervals.assign_turns(p, t, ["m"]).collect()}
    linear = {(r.m, r.idx): r.speaker for r in intervals.assign_turns_linear(p, t, ["m"]).collect()}
    for m, i, x in points:
        own = [u for u in turns if u[0] == m]
        assert got[m, i] == speaker_at(own, x)
        inside = [u for u in own if u[1] <= x <= u[2]]
        best = min(inside, key=lambda u: u[3]) if inside else min(own, key=lambda u: (min(abs(x - u[1]), abs(x - u[2])), u[3])) if own else None
        assert linear[m, i] == (best[4] if best else None)
    assert got[4, 0] == "B" and linear[4, 0] == "A"
    rows = spark.createDataFrame([(3, 0, 0.0, 1.0, "own"), (4, 0, 5.0, 6.0, "own")], "m long, idx long, start double, end double, speaker string")
    assert {r.m: r.speaker for r in intervals.assign_speakers(rows, t, ["m"]).collect()} == {3: "own", 4: "B"}
    a = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 20.0), (1, 10.0, 25.0), (1, 30.0, 60.0)], "m long, pos double, time double")
    q = spark.createDataFrame([(1, k, x) for k, x in enumerate((-5.0, 0.0, 5.0, 10.0, 20.0, 99.0))], "m long, idx long, at double")
    assert [r.time for r in intervals.interpolate(q, a, ["m"]).orderBy("at").collect()] == [10.0, 10.0, 15.0, 20.0, 42.5, 60.0]


def test_time_flags(spark):
    rows = [(0, 0.0, 2.0), (1, 0.1, 2.0), (2, 0.2, 2.0), (3, 5.0, 3.0), (4, 6.0, 200.0), (5, 6.0, 200.0), (6, 300.0, 300.0), (7, 300.0, 301.0)]
    df = spark.createDataFrame([("m", *r) for r in rows], "k string, i long, start double, end double")
    got = [r.odd for r in ordered.time_flags(df, ["k"], ["i"], 90.0, 0.7).orderBy("i").collect()]
    assert got == [False, True, False, True, True, True, False, False]


def test_deep_trees_and_cycles(spark):
    chain = spark.createDataFrame([(f"n'{k}", f"n'{k - 1}" if k else None) for k in range(70)], "id string, parent_id string")
    assert relational.subtree(chain, "n'0").count() == 70 and relational.subtree(chain, "none").count() == 0
    loops = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("x", None), ("y", "x"), ("z", "gone")], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        relational.subtree(loops, "a")
    assert sorted(map(tuple, relational.subtree(loops, "x").collect())) == [("x", 0), ("y", 1)]  # cycles elsewhere are elsewhere
    long = spark.range(100_000).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    found = relational.subtree(long, 99_000).agg(F.count("*").alias("n"), F.max("depth").alias("d")).first()
    assert (found.n, found.d) == (1000, 999)
    wide = spark.range(300_000).select(F.col("id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3)).alias("parent_id"))
    assert relational.subtree(wide, 0).count() == 300_000


def test_moves_of_folders(spark):
    nodes = spark.createDataFrame([("a", None, True), ("b", "a", True), ("c", "b", True), ("d", None, True), ("e", "d", True), ("f", "e", False), ("g", None, False)], "id string, parent_id string, is_folder boolean")
    moves = [("b", "d"), ("a", "d"), ("a", "c"), ("d", "a"), ("e", "a"), ("b", "a"), ("g", "c"), ("a", "a"), ("e", "g"), ("e", "c"), ("c", "e")]
    got = {(r.moved, r.target): r.allowed for r in relational.allowed_moves(nodes, spark.createDataFrame(moves, "moved string, target string")).collect()}
    yes = {("b", "d"), ("e", "a"), ("g", "c"), ("c", "e")}
    assert got == {m: m in yes for m in moves}


def test_best_match_keeps_all_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 2.0]), (5, [-1.0, -1.0])], "qid long, qvec array<double>")
    lib = spark.createDataFrame([(k, v) for k, v in ((7, [1.0, 0.1]), (8, [1.0, 0.1]), (9, [0.0, 1.0]), (6, [0.5, 0.5]))], "lid long, lvec array<double>")
    got = {r.qid: (r.lid, r.matched) for r in vectors.best_match(q, lib, 0.9).collect()}
    assert got == {1: (7, True), 2: (None, False), 3: (None, False), 4: (9, True), 5: (9, False)}


def test_best_match_by_bounds_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    near = lambda n: centres[rng.integers(40, size=n)] + rng.normal(size=(n, 12)) * 0.05
    lib = [*near(1500).tolist(), [0.0] * 12, *rng.normal(size=(60, 5)).tolist(), None, []]
    q = [*near(200).tolist(), *rng.normal(size=(20, 12)).tolist(), [0.0] * 12, *rng.normal(size=(20, 5)).tolist(), None, [1.0] * 3, []]
    want = {}
    for i, v in enumerate(q):
        own = [(vectors._scores(np.array([v]), np.array([x]))[0, 0], -k) for k, x in enumerate(lib) if v and x and len(x) == len(v)]
        own = [o for o in own if o[0] > -1]
        want[i] = max(own) if own else (None, None)
    dfs = spark.createDataFrame(list(enumerate(q)), "qid long, qvec array<double>"), spark.createDataFrame(list(enumerate(lib)), "lid long, lvec array<double>")
    for block in (10_000, 25):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {r.qid: r for r in vectors.best_match(*dfs, 0.9).collect()}
        for i, (score, k) in want.items():
            assert got[i].score == (None if score is None else pytest.approx(score, abs=1e-9))
            assert score in (None, 0.0) or got[i].lid == -k
            assert got[i].matched == (score is not None and score >= 0.9)
    every = len(lib) / 25
    assert 0 < np.mean([got[i].blocks for i in range(200)]) < every / 4  # of blocks of 25, most are never met


def test_ordinals_count_on_over_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 1000, "x") for k in range(1000)], "k long, v string").repartition(6)
    assert sorted((r.k, r.n) for r in vectors.ordinals(df, ["k"], "n").collect()) == [(k, k) for k in range(1000)]
    assert vectors.ordinals(df.limit(0), ["k"], "n").count() == 0


def test_speakers_by_landmarks_equal_the_full_clusters(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(4)[:3]
    rows = [(m, k, (centres[k // 7 % 3] + rng.normal(size=4) * 0.05).tolist() if k % 50 else None) for m, n in (("long", 600), ("short", 30), (None, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "meeting string, part long, v array<double>")
    whole = {(r.meeting, r.part): r.speaker for r in vectors.spectral_speakers(df, ["meeting"], "part", "v", 3).collect()}
    parts = {(r.meeting, r.part): r.speaker for r in vectors.spectral_speakers(df, ["meeting"], "part", "v", 3, landmarks=40).collect()}
    assert whole == parts and len(whole) == len(rows)
    assert whole["long", 1] == "Speaker 1" and whole["long", 0] is None and whole["long", 8] == "Speaker 2" and whole["long", 15] == "Speaker 3"
    assert vectors.spectral_speakers(df.limit(0), ["meeting"], "part", "v").count() == 0


def test_vectors(spark):
    labels = vectors.spectral_labels([[1, 0, 0], [0, 1, 0], [1, 0.1, 0], [0.1, 1, 0]])
    assert labels[0] == labels[2] != labels[1] == labels[3]
    assert vectors.spectral_labels([[1, 0], [1, 0.1]]) == {0: 0, 1: 1} and len(vectors.spectral_labels([[0, 0], [1, 0], [0, 1]])) == 3
    assert vectors.spectral_labels([[1, 0]]) == {0: 0} and vectors.spectral_labels([]) == {} and 1 not in vectors.spectral_labels([[1, 0], None, [0, 1]])
    assert vectors.greedy_clusters([np.array(v, float) for v in ([1, 0], [0, 1], [1, 0.1], [0, 2])], 0.9) == [0, 1, 0, 1]
    df = spark.createDataFrame([([3.0, 4.0], [1.0])], "a array<double>, b array<double>")
    r = df.select(vectors.weighted_merge(F.col("a"), F.lit(1), F.col("b"), F.lit(1)).alias("m"), vectors.blend(F.col("a"), F.lit(2), F.col("b")).alias("e"), vectors.cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert r.m == [3.0, 4.0] and r.e == [1.0] and r.c == -1.0


def test_merge_update_and_sources(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, made string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "z")], "k long, v string, made string")
    assert sorted(map(tuple, relational.keyed_merge(old, new, ["k"], ("made",)).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert relational.partial_update(old, "k", 1, {"v": None}).collect() == old.collect()
    assert relational.partial_update(old, "k", 1, {}, clear=("v",)).filter("k = 1").first().v is None
    (tmp_path / "n.txt").write_text("héllo")
    (tmp_path / "n.bin").write_bytes(b"\x00")
    got = {r.path.rsplit("/")[-1]: r.text for r in store.document_text(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"n.txt": "héllo", "n.bin": ""}
    assert store.wav_samples(b"\x00" * 44 + struct.pack("<2h", 5, -6)) == [5, -6]
    with pytest.raises(ValueError):
        store.wav_samples(b"")
    store.replace_partitions(old, str(tmp_path / "t"), "k")
    store.replace_partitions(new.filter("k = 2"), str(tmp_path / "t"), "k")
    assert sorted((r.k, r.made) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "x"), (2, "z")]


def test_stream_windows(spark, tmp_path):
    rows, state = windows.cut(0, 0, 0.0, [100], 160_000, 32_000)
    assert not rows
    rows, state = windows.cut(*state, [159_900], 160_000, 32_000)
    assert rows == [(0, 0.0, 5.0, 160_000)] and state == (0, 1, 5.0)
    assert windows.flush_tail(50, 1, 5.0, 32_000) is None and windows.flush_tail(3200, 1, 5.0, 32_000) == (1, 5.0, 5.1, 3200)
    schema = "job_id string, seq long, pcm binary"
    frames = spark.createDataFrame([*[(j, s, bytes(50_000)) for j in "ab" for s in range(8)], ("b", 8, None)], schema)
    frames.write.parquet(str(tmp_path / "in"))
    out = windows.pcm_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("pcm_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("pcm_out").collect())) == [(j, i, i * 5.0, i * 5.0 + 5.0, 160_000) for j in "a" for i in range(2)] + [("b", 0, 0.0, 5.0, 160_000), ("b", 1, 5.0, 10.0, 160_000), ("b", 2, 10.0, 12.5, 80_000)]


def test_stream_of_segments_and_centroids(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, [1.0, 3.0]), ("p", 1, [3.0, 5.0]), ("q", 0, [0.0, 1.0])], "project_id string, idx long, v array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.persisted(stream, str(tmp_path / "out"), "project_id", str(tmp_path / "cp1"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = windows.running_centroids(stream, "project_id", "v").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.project_id, r.pos): (r.mean, r.n) for r in spark.table("means").collect()} == {("p", 0): (2.0, 2), ("p", 1): (4.0, 2), ("q", 0): (0.0, 1), ("q", 1): (1.0, 1)}
