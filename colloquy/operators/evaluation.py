"""Scores of transcripts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx


def compare_transcripts(rows: DataFrame, a: str, b: str, chinese: bool) -> DataFrame:
    """rows with the scores of two texts, the winner (A of equals) and the difference of their readability."""
    rows = rows.withColumns({"score_a": tx.transcript_scores(F.col(a), chinese), "score_b": tx.transcript_scores(F.col(b), chinese)})
    better = F.when(F.col("score_a.readability") >= F.col("score_b.readability"), "A").otherwise("B")
    return rows.withColumns({"winner": better, "score_diff": F.abs(F.col("score_a.readability") - F.col("score_b.readability"))})


def automatic_reference(transcript: Column) -> Column:
    """What a transcript says of quantities, and up to fifteen imperative phrases, in order of appearance."""
    found = lambda p: F.array_distinct(F.regexp_extract_all(transcript, F.lit(p), F.lit(0)))
    return F.struct(F.array().cast("array<string>").alias("topics"), F.slice(found(fixed.IMPERATIVES), 1, 15).alias("action_items"), found(fixed.QUANTITIES).alias("key_data"))


def _share(references: Column, hit) -> Column:
    """The share of references that hit; 1 without any."""
    n = F.size(references)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(references, hit)).cast("double") / n)


def _said(text: Column, least: float):
    """Whether enough of a reference's keywords are in the text."""

    def hit(reference):
        words = F.filter(tx.keywords(reference), lambda w: ~w.isin(fixed.STOP_WORDS))
        return F.size(F.filter(words, lambda w: F.contains(text, w))) >= F.greatest(F.lit(1.0), F.size(words) * least)

    return hit


def summary_scores(rows: DataFrame, summary: str = "summary", reference: str = "reference") -> DataFrame:
    """rows with topic_coverage, action_item_recall, key_data_recall, structural_score and overall_score.

    summary is a struct of topic, conclusions, action_items (structs with a task), discussion (structs of topic and
    summary) and key_data; reference one of topics, action_items and key_data. Nulls count as empty.
    """
    s, ref = (lambda c: F.col(f"{summary}.{c}")), (lambda c: F.col(f"{reference}.{c}"))
    some = lambda c: F.coalesce(F.size(s(c)), F.lit(0)) > 0
    texts = lambda c, f: F.coalesce(F.transform(s(c), f), F.array().cast("array<string>"))
    tasks = texts("action_items", lambda x: F.coalesce(x["task"], F.lit("")))
    talk = F.flatten(F.coalesce(F.transform(s("discussion"), lambda d: F.array(F.coalesce(d["topic"], F.lit("")), F.coalesce(d["summary"], F.lit("")))), F.array().cast("array<array<string>>")))
    full = F.array_join(F.concat(F.array(F.coalesce(s("topic"), F.lit(""))), texts("conclusions", lambda x: x), tasks, talk, texts("key_data", lambda x: x)), " ")
    rows = rows.withColumns({"_full": full, "_tasks": F.array_join(tasks, " ")})
    numbers = lambda d: F.regexp_extract_all(d, F.lit("[0-9]+"), F.lit(0))
    kept = lambda d: F.when(F.size(numbers(d)) > 0, F.exists(numbers(d), lambda x: F.contains(F.col("_full"), x))).otherwise(F.contains(F.col("_full"), d))
    structure = sum((c.cast("int") for c in (F.coalesce(s("topic") != "", F.lit(False)), *map(some, ("conclusions", "action_items", "discussion", "key_data")))), F.lit(0)) / 5
    w = fixed.SUMMARY_WEIGHTS
    rows = rows.withColumns({
        "topic_coverage": _share(ref("topics"), _said(F.col("_full"), 0.4)), "action_item_recall": _share(ref("action_items"), _said(F.col("_tasks"), 0.3)),
        "key_data_recall": _share(ref("key_data"), kept), "structural_score": structure,
    })
    overall = w["topics"] * F.col("topic_coverage") + w["actions"] * F.col("action_item_recall") + w["data"] * F.col("key_data_recall") + w["structure"] * F.col("structural_score")
    return rows.withColumn("overall_score", overall).drop("_full", "_tasks")


def recommended_engine(language: Column, memory_gb: Column, openai: Column, alibaba: Column) -> Column:
    """(engine, model): the best local one that fits, else one in the cloud, else the smallest."""
    chinese = language.isin("zh", "yue", "wuu", "min_nan", "gan", "hakka", "xiang")
    one = lambda engine, model: F.struct(F.lit(engine).alias("engine"), F.lit(model).alias("model"))
    cloud = {k: one(*v) for k, v in fixed.CLOUD_ENGINES.items()}
    out = F.when(F.lit(False), cloud["none"])
    for group, of in (("zh", chinese), ("other", ~chinese)):
        for least, engine, model in fixed.LOCAL_ENGINES[group]:
            out = out.when(of & (memory_gb >= least), one(engine, model))
    return out.when(chinese & alibaba, cloud["alibaba"]).when(openai, cloud["openai"]).when(~chinese & alibaba, cloud["alibaba"]).otherwise(cloud["none"])
