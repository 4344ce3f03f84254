"""Literal cases of exports, retrieval, corrections, scores and voiceprints."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import audio, correction, evaluation, exports, knowledge, relational, summaries, vectors
from colloquy.plans import catalog, meetings

SEGMENTS = "project_id string, idx long, start double, end double, speaker string, text string"
SUMMARY = "struct<topic:string,conclusions:array<string>,action_items:array<struct<action:string,owner:string,deadline:string>>,discussion:string>"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [("p", 0, 0.0, 5.0, "Ann", "Hello | all"), ("p", 1, 65.0, 70.0, None, "Next"), ("q", 0, 3700.0, 3705.0, "Bo", "Late")]
    return spark.createDataFrame(rows, SEGMENTS)


@pytest.mark.parametrize("given,want", [
    ("1个月", "一个月"), ("3到5年", "三到五年"), ("2024年", "2024年"), ("13812345678", "13812345678"), ("192.168.1.1", "192.168.1.1"),
    ("一两百美金", "一两百美金"), ("用了80%的", "用了80%的"), ("10个", "一零个"), ("第#12号", "第#12号"), ("hello 5", "hello 5"), ("版本v2.0的", "版本v2.0的"), ("", ""),
])
def test_numbers(given, want):
    assert tx.rewrite_numbers(given) == want


def test_exports(spark, talk):
    summary = spark.createDataFrame([("p", ("Plan", ["Ship it"], [("Write", "Ann", "Friday"), ("Test", "", None)], "Long talk"))], f"project_id string, summary {SUMMARY}")
    body = lambda df: {r.project_id: r.body for r in df.collect()}
    assert body(exports.plain_text(talk)) == {"p": "[00:00] [Ann] Hello | all\n[01:05] Next", "q": "[61:40] [Bo] Late"}
    md = body(exports.markdown(talk, summary))
    assert md["p"] == "# Plan\n\n## Conclusions\n\n- Ship it\n\n## Action Items\n\n- [ ] Write (@Ann) [Due: Friday]\n- [ ] Test\n\n## Discussion\n\nLong talk\n\n## Transcript\n\n`[00:00]` **Ann**: Hello | all\n\n`[01:05]` Next\n"
    assert md["q"] == "## Transcript\n\n`[61:40]` **Bo**: Late\n"
    doc = {k: json.loads(v) for k, v in body(exports.json_document(talk, summary)).items()}
    assert [s["text"] for s in doc["p"]["segments"]] == ["Hello | all", "Next"] and doc["p"]["segments"][1]["speaker"] is None
    assert doc["p"]["summary"]["topic"] == "Plan" and doc["q"]["summary"] is None
    assert "| 00:00 | Ann | Hello \\| all |" in body(exports.markdown_table(talk))["p"]


def test_markdown_round_trip(spark, talk):
    text = exports.speaker_markdown(talk)
    assert {r.project_id: r.body for r in text.collect()}["p"] == "**Ann:**\nHello | all\nNext"
    edited = spark.createDataFrame([("p", "\n**Zoe**：\n one \n\n**Bold** words\nthree")], "project_id string, body string")
    got = [tuple(r) for r in exports.read_markdown(edited, talk).orderBy("idx").collect()]
    assert got == [("p", 0, 0.0, 5.0, "one", "Zoe"), ("p", 1, 65.0, 70.0, "**Bold** words", "Zoe"), ("p", 2, 0.0, 0.0, "three", "Zoe")]


def test_segment_chunks(spark):
    rows = [("p", k, float(k), k + 0.5, f"s{k}", t) for k, t in enumerate(["a" * 300, " ", "b" * 300, "c" * 10])] + [("blank", 0, 0.0, 1.0, "x", " ")]
    got = [tuple(r) for r in knowledge.segment_chunks(spark.createDataFrame(rows, SEGMENTS)).orderBy("position").collect()]
    assert got == [("p", 0, "a" * 300, 0.0, 2.5, "s0"), ("p", 1, "b" * 300 + " " + "c" * 10, 2.0, None, "s2")]


def test_index_and_rerank(spark, talk):
    projects = spark.createDataFrame([("p", False), ("q", True), ("r", False)], "project_id string, is_folder boolean")
    notes = spark.createDataFrame([("p", "note 注"), ("q", "hidden")], "project_id string, text string")
    briefs = spark.createDataFrame([("p", "# Plan", None)], "project_id string, raw_markdown string, topic string")
    files = spark.createDataFrame([("p", "f.txt", "file"), ("p", "g.pdf", "")], "project_id string, filename string, text string")
    chunks = knowledge.index_chunks(projects, talk, briefs, notes, files)
    rows = [(r.source_type, r.text, json.loads(r.metadata_json)) for r in chunks.collect()]
    assert sorted(r[:2] for r in rows) == [("attachment", "file"), ("note", "note 注"), ("segment", "Hello | all Next"), ("summary", "# Plan")]
    assert {r[0]: r[2] for r in rows}["attachment"] == {"filename": "f.txt"} and {r[0]: r[2] for r in rows}["summary"] == {"topic": ""}
    assert {r.project_id: r.chunks for r in knowledge.index_counts(projects, chunks).collect()} == {"p": 4, "r": 0}
    found = spark.createDataFrame([(0, "a", 0.1), (1, "b", 0.2)], "ordinal long, text string, score double")
    answer = spark.createDataFrame([(0, 1, 0.95), (1, 0, 0.8), (2, 7, 0.5)], "rank long, ordinal long, relevance double")
    assert [(r.text, r.score) for r in knowledge.reranked(found, answer).collect()] == [("b", 0.95), ("a", 0.8)]


def test_corrections_and_alignment(spark, talk):
    answers = spark.createDataFrame([("p", 0, "<think>[1] x</think>[0] one\n[9] none\n[1]   "), ("p", 1, "[0] two")], "project_id string, chunk long, answer string")
    got = {(r.project_id, r.idx): r.text for r in correction.corrected(talk, answers, ["project_id"]).collect()}
    assert got == {("p", 0): "two", ("p", 1): "Next", ("q", 0): "Late"}
    said = spark.createDataFrame([("m", 0, "你好, world"), ("m", 1, "!"), ("m", 2, "再见了")], "m string, idx long, text string")
    items = spark.createDataFrame([("m", k, float(k), k + 0.5) for k in range(5)], "m string, pos long, start double, end double")
    assert [(r.start, r.end) for r in correction.align(said, items, ["m"]).orderBy("idx").collect()] == [(0.0, 2.5), (None, None), (3.0, 4.5)]


def test_split_transcript():
    assert tx.split_transcript("abc", 5) == ["abc"] and "".join(tx.split_transcript("x" * 23, 5)) == "x" * 23
    assert tx.split_transcript("aaaa. bbbb. cc", 6) == ["aaaa.", " bbbb.", " cc"]


KINDS = "summary struct<topic:string,conclusions:array<string>,action_items:array<struct<task:string>>,discussion:array<struct<topic:string,summary:string>>,key_data:array<string>>, reference struct<topics:array<string>,action_items:array<string>,key_data:array<string>>"


def test_summary_scores(spark):
    good = ("产品评审", ["按时发布"], [("完成接口文档",)], [("预算讨论", "预算增加了20万元"), ("招聘计划", "招聘3名工程师")], ["20万元"])
    empty = (None, [], [], [], None)
    ref = (["预算讨论", "招聘计划"], ["完成接口文档"], ["20万元", "无数字"])
    rows = [(good, ref), (empty, ref), (good, ([], [], []))]
    got = evaluation.summary_scores(spark.createDataFrame(rows, KINDS)).collect()
    assert (got[0].topic_coverage, got[0].action_item_recall, got[0].key_data_recall, got[0].structural_score) == (1.0, 1.0, 0.5, 1.0)
    assert got[0].overall_score == pytest.approx(0.9)
    assert got[1].topic_coverage == got[1].action_item_recall == got[1].structural_score == 0.0
    assert got[2].topic_coverage == got[2].action_item_recall == 1.0


def test_reference_and_comparison(spark):
    df = spark.createDataFrame([("我们需要完成接口文档和测试，预算20万元。你先去准备会议室。", "对对对对就是开会1个月", "我们开会")], "t string, a string, b string")
    ref = df.select(evaluation.automatic_reference(F.col("t")).alias("r")).first().r
    assert ref.key_data == ["20万元"] and ref.action_items == ["我们需要完成接口文档和测试", "你先去准备会议室"]
    got = evaluation.compare_transcripts(df, "a", "b", True).first()
    assert got.winner == "B" and got.score_b.readability == 1.0 and got.score_a.number_issues == 2 and got.score_diff == pytest.approx(1 - got.score_a.readability)


def test_hallucinations_and_clean_up(spark):
    rows = [("今天我们开会讨论项目", 0.9), ("请订阅我的频道", 0.9), ("this is a long English sentence here", 0.9), (".", 0.05), ("项目预算需要3个月审批", 0.15), ("嗯", 0.9)]
    df = spark.createDataFrame([("p", k, k * 5.0, k * 5.0 + 4, t, c) for k, (t, c) in enumerate(rows)], "project_id string, idx long, start double, end double, text string, confidence double")
    assert [r.flag for r in meetings.flagged(df, "zh").orderBy("idx").collect()] == [False, True, True, True, False, False]
    assert [r.text for r in meetings.clean(df, "zh").orderBy("idx").collect()] == ["今天我们开会讨论项目", "项目预算需要三个月审批"]


def test_voiceprints(spark):
    q = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (0, 3, [0.1, 1.0]), (0, 4, None), (0, 5, [-1.0, 0.0]), (0, 6, [0.0, -1.0])], "batch long, qid long, qvec array<double>")
    lib = spark.createDataFrame([(10, "Ann", [1.0, 0.1], 3), (11, "Bo", None, 0), (12, "未知说话人 1", [1.0], 2)], "lid long, name string, lvec array<double>, n long")
    got = {r.qid: (r.lid, r.name, r.fresh) for r in vectors.match_or_enrol(q, lib, 0.8).collect()}
    assert got == {1: (10, "Ann", False), 2: (11, "Bo", False), 3: (11, "Bo", False), 5: (12, "未知说话人 1", False), 6: (None, "未知说话人 2", True)}
    more = spark.createDataFrame([(1, 7, [0.0, 1.0]), (1, 8, [0.0, -1.0]), (1, 9, [-1.0, 0.1])], q.schema)
    both = [(r.batch, r.lid, r.name) for r in vectors.match_or_enrol(q.unionByName(more), lib, 0.8).collect() if r.batch == 1 or r.lid is None]
    assert sorted(both, key=str) == [(0, None, "未知说话人 2"), (1, None, "未知说话人 3"), (1, None, "未知说话人 4"), (1, None, "未知说话人 5")]  # unique over batches
    after = {r.lid: r for r in vectors.learned_voiceprints(vectors.match_or_enrol(q, lib, 0.8), q, lib).collect()}
    assert after[10].n == 4 and after[11].n == 3 and after[12].lvec == [-1.0, 0.0] and after[10].lvec[0] == pytest.approx(0.997, abs=0.002)


def test_changes(spark):
    have = spark.createDataFrame([("a",)], "name string")
    new = spark.createDataFrame([("b",), ("b",), ("a",)], "name string")
    assert sorted(r.name for r in relational.created_if_absent(have, new, "name").collect()) == ["a", "b"]


def test_audio(spark):
    row = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in (3, -4, -5, 0, 7)]).alias("a"), F.array(*[F.lit(x).cast("long") for x in (2, 2)]).alias("b"))
    r = row.select(audio.mono(F.col("a"), 2).alias("m"), audio.mixed(F.col("a"), F.col("b")).alias("x"), audio.resampled(F.col("a"), 2, 1).alias("d"), audio.resampled(F.col("b"), 1, 2).alias("u")).first()
    assert r.m == [0, -2, 7] and r.x == [2, -1, -2, 0, 3] and r.d == [3, -5, 7] and r.u == [2, 2, 2, 2]
    loud, quiet = [0.8, -0.8] * 500, [0.0] * 1000  # a second each at 1000 samples a second
    rows = spark.createDataFrame([("a", 10.0, 15.0, loud + quiet + loud + quiet + quiet), ("b", 0.0, 1.0, quiet), ("c", 0.0, 0.01, [0.1]), ("d", 0.0, 0.0, [])], "k string, start double, end double, samples array<double>")
    got = sorted((r.k, round(r.start, 2), round(r.end, 2)) for r in audio.speech_regions(rows, ["k"], 1000).collect())
    assert got == [("a", 10.0, 11.02), ("a", 11.98, 13.0), ("b", 0.0, 1.0), ("c", 0.0, 0.01)]


def test_speakers_of_segments(spark):
    parts = [(0, k // 3, k, v) for k, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], [0.0, 1.0], [0.0, 0.9], [1.0, 0.0], [1.0, 0.05], None])]
    got = audio.diarised(spark.createDataFrame(parts, "r long, s long, part long, embedding array<double>"), "r", "s", 2).orderBy("s").collect()
    assert got[0].speaker == got[2].speaker != got[1].speaker
    alone = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 1, None)], "r long, s long, part long, embedding array<double>")
    assert audio.diarised(alone, "r", "s").count() == 0


def test_recognisers_and_map_reduce(spark):
    body = json.dumps([{"text": "whole", "sentence_info": [{"text": " a ", "start": 1234.4, "end": 2000}, {"text": "b"}]}, {"text": " alone "}, {"text": ""}])
    got = [tuple(r) for r in audio.sentence_segments(spark.createDataFrame([(1, body)], "k long, body string"), "k", "body").collect()]
    assert got == [(1, 0, 1.234, 2.0, "a"), (1, 1, 0.0, 0.0, "b"), (1, 2, 0.0, 0.0, "alone")]
    rows = spark.createDataFrame([(1, ["2", "x", "3"])], "k long, p array<string>")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    assert audio.map_reduce(rows, "k", F.col("p"), lambda x: x.try_cast("int"), total).first().result == 5
    with pytest.raises(Exception, match="every piece failed"):
        audio.map_reduce(rows, "k", F.col("p"), lambda x: F.lit(None).cast("int"), total).collect()


def test_items_are_located(spark, talk):
    from colloquy.operators import intervals

    items = spark.createDataFrame([("p", 0, "the NEXT thing"), ("p", 1, "zzz"), ("x", 2, "next")], "project_id string, item long, text string")
    assert {r.item: r.start for r in intervals.locate(items, talk, "project_id").collect()} == {0: 65.0, 1: None, 2: None}
    assert intervals.common_length("abcdef", "xxcdey") == 3 and intervals.common_length("", "a") == 0


def test_summaries(spark):
    answer = {
        "topic": "T", "conclusions": ["c1"], "decisions": [{"decision": "d", "made_by": "Bo", "reasoning": "r"}], "next_steps": ["n"], "participants": ["Ann", "Bo"],
        "action_items": [{"assignee": "Ann", "task": "write", "priority": "high", "deadline": "May"}, {"task": "rest"}],
        "discussion": [{"topic": "x", "summary": "y", "participants": ["Ann"], "key_points": ["k"]}], "technical_details": [{"category": "db", "details": "z"}],
    }
    df = spark.createDataFrame([(0, "```json\n" + json.dumps(answer) + "\n```"), (1, "Sorry."), (2, "{}")], "k long, answer string").select("k", summaries.parsed(F.col("answer")).alias("summary"))
    got = {r.k: r.summary for r in df.collect()}
    assert got[1].raw == "Sorry." and got[1].topic == "" and got[2].raw == "" and got[2].conclusions == []
    assert got[0].action_items[1].priority == "medium" and got[0].action_items[1].deadline is None and got[0].key_data == []
    assert got[0].raw == "\n".join(["# T", "", "## 结论", "", "- c1", "", "## 决策", "", "- **d** (Bo) — r", "", "## 待办事项", "", "- [ ] write 🔴 (@Ann) [截止: May]", "- [ ] rest", "", "## 讨论要点", "", "### x", "", "**参与者:** Ann", "", "y", "", "**关键要点:**", "", "- k", "", "## 技术细节", "", "- **db**: z", "", "## 下一步", "", "- n", "", "## 参与者", "", "@Ann、@Bo", ""])
    nodes = {r.id: r for r in summaries.layout(summaries.tree(df.filter("k = 0"), "k"), "k").collect()}
    assert [nodes[i].label for i in ("root", "action-0", "action-1", "decision-0", "disc-0", "tech-0", "next-0")] == ["T", "Ann: write (May)", ": rest", "d (Bo)", "x: y", "db: z", "n"]
    assert nodes["tech-0"].parent == "tech" and nodes["tech"].parent == "root" and nodes["conclusions"].x == 360.0
    assert (nodes["conclusion-0"].y, nodes["action-0"].y, nodes["action-1"].y, nodes["actions"].y) == (0.0, 56.0, 112.0, 84.0)
    assert nodes["root"].y == (nodes["conclusions"].y + nodes["nextsteps"].y) / 2
    alone = summaries.layout(summaries.tree(df.filter("k = 2"), "k"), "k").collect()
    assert [(r.id, r.y) for r in alone] == [("root", 0.0)]


class Flaky:
    """Fails at first, then answers; never about 'bad'."""

    calls = 0

    def rank(self, asked):
        self.calls += 1
        if self.calls == 1 or any(q == "bad" for q, _ in asked):
            raise RuntimeError("busy")
        return [[(1, 0.9), (0, 0.4), (1, 0.1), (9, 1.0)] for _ in asked]


def test_rerank_tries_again_and_falls_back(spark):
    rows = [(q, q, o, f"{q}{o}") for q in ("good", "bad", "fine") for o in range(3)]
    df = spark.createDataFrame(rows, "key string, question string, ordinal long, text string").coalesce(1)
    got = sorted((r.key, r.rank, r.ordinal, r.relevance, r.fallback) for r in knowledge.rerank(df, "key", "question", Flaky, "flaky", 2).collect())
    assert got == [("bad", 0, 0, None, True), ("bad", 1, 1, None, True), ("fine", 0, 1, 0.9, False), ("fine", 1, 0, 0.4, False), ("good", 0, 1, 0.9, False), ("good", 1, 0, 0.4, False)]
    assert knowledge.rerank(df.limit(0), "key", "question", Flaky, "flaky", 2).count() == 0


def test_chinese_clean_up_over_the_whole_table(spark, small):
    """Against plain restatements with Python's regular expressions."""
    import re

    digits = "零一二三四五六七八九"
    cjk = "[\u4e00-\u9fff]"
    for r in catalog.queries()["chinese_clean_up"](spark, small).collect():
        merged = re.sub(rf"({cjk})\1{{2,}}", r"\1", r.text)
        for n in range(6, 1, -1):
            merged = re.sub(rf"({cjk}{{{n}}})\1+", r"\1", merged)
        assert r.merged == merged
        found = re.findall(rf"({cjk}{{1,6}})\1{{2,}}", r.text)
        assert r.repetition == pytest.approx(min(1, sum(len(r.text) - len(r.text.replace(m * 3, "")) for m in found) / len(r.text)))
        assert not re.search(rf"({cjk})\1\1", r.filtered) and not r.filtered.startswith("嗯")
        back = "".join(str(digits.index(c)) if c in digits else c for c in r.rewritten)
        assert back == r.text and re.findall(r"\d{4,}", r.rewritten) == re.findall(r"\d{4,}", r.text)  # numbers change their script alone
