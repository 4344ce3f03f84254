"""Transcripts and summaries as text: Markdown, plain text, JSON, and Markdown read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def _joined(segments: DataFrame, key: str, line: Column, name: str, by: str = "\n") -> DataFrame:
    """A meeting's lines in order of idx as one text: a meeting is bounded by its length."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"])
    return segments.groupBy(key).agg(F.array_join(lines, by).alias(name))


def _named(before: str, after: str) -> Column:
    return F.when(F.coalesce("speaker", F.lit("")) == "", "").otherwise(F.concat(F.lit(before), F.col("speaker"), F.lit(after)))


def plain_text(segments: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, body): a line `[mm:ss] [speaker] text` a segment (idx, start, speaker, text)."""
    return _joined(segments, key, F.concat(F.lit("["), tx.clock(F.col("start")), F.lit("] "), _named("[", "] "), F.coalesce("text", F.lit(""))), "body")


def json_document(segments: DataFrame, summaries: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, body): {"segments": [...], "summary": ...}; summaries are (key, summary), a meeting may lack one."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", "start", "end", "text", "speaker"))), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "text", "speaker")]))
    grouped = segments.groupBy(key).agg(rows.alias("segments")).join(summaries, key, "left")
    return grouped.select(key, F.to_json(F.struct("segments", "summary"), {"ignoreNullFields": "false"}).alias("body"))


def _section(title: str, lines: Column) -> Column:
    """A headed list with a blank line after it; nothing for an empty one."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise("")


def preferred(edited: Column, raw: Column, structured: Column) -> Column:
    """A summary's Markdown as its user edited it, else as the model gave it, else as made of its parts; empty ones don't count."""
    given = lambda c: F.when(c != "", c)
    return F.coalesce(given(edited), given(raw), structured)


def markdown(segments: DataFrame, summaries: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, body): the summary's topic, conclusions, action items (action, owner, deadline) and discussion, then the transcript."""
    spoken = F.concat(F.lit("`["), tx.clock(F.col("start")), F.lit("]` "), _named("**", "**: "), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = _joined(segments, key, spoken, "_lines").join(summaries, key, "left")
    s = lambda c: F.col(f"summary.{c}")
    part = lambda x, before, after: F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(before), x, F.lit(after)))
    items = F.transform(s("action_items"), lambda x: F.concat(F.lit("- [ ] "), F.coalesce(x["action"], F.lit("")), part(x["owner"], " (@", ")"), part(x["deadline"], " [Due: ", "]")))
    head = F.concat(
        F.lit("# "), F.coalesce(s("topic"), F.lit("Meeting Notes")), F.lit("\n\n"),
        _section("Conclusions", F.transform(s("conclusions"), lambda c: F.concat(F.lit("- "), c))), _section("Action Items", items),
        part(s("discussion"), "## Discussion\n\n", "\n\n"),
    )
    return rows.select(key, F.concat(F.when(F.col("summary").isNull(), "").otherwise(head), F.lit("## Transcript\n\n"), "_lines").alias("body"))


def markdown_table(segments: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, body): the transcript as a table, pipes escaped and line ends made spaces."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    line = F.concat(F.lit("| "), tx.clock(F.col("start")), F.lit(" | "), cell("speaker"), F.lit(" | "), cell("text"), F.lit(" |"))
    body = F.concat(F.lit("| Time | Speaker | Text |\n|------|---------|------|\n"), "body")
    return _joined(segments, key, line, "body").withColumn("body", body)


def speaker_markdown(segments: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, body): texts line by line, with a line `**speaker:**` before each change of a named speaker."""
    w = Window.partitionBy(key).orderBy("idx")
    named = F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker"))
    before = F.last("_named", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("_named", named).withColumn("_before", before)
    changed = F.col("_named").isNotNull() & ~F.col("_named").eqNullSafe(F.col("_before"))
    return _joined(rows, key, F.concat(F.when(changed, F.concat(F.lit("**"), "speaker", F.lit(":**\n"))).otherwise(""), F.coalesce("text", F.lit(""))), "body")


def read_markdown(edited: DataFrame, originals: DataFrame, key: str = "project_id") -> DataFrame:
    """Edited Markdown (key, body) -> segments (key, idx, start, end, text, speaker): a line of bold text only names the speaker of
    those after it, every other line that isn't blank is a segment, with the times of the original in its place."""
    lines = edited.select(key, F.posexplode(F.split("body", "\n")).alias("_at", "_line")).withColumn("_line", F.trim("_line")).filter("_line <> ''")
    name = F.trim(F.regexp_replace(F.regexp_extract("_line", r"^\*\*(.+?)\*\*\s*[:：]?\s*$", 1), r"[:：\s]+$", ""))
    w = Window.partitionBy(key).orderBy("_at")
    lines = lines.withColumn("_name", F.when(name != "", name)).withColumn("_speaker", F.last("_name", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spoken = lines.filter("_name is null").withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    kept = originals.select(key, "idx", "start", "end", F.col("speaker").alias("_own"))
    return spoken.join(kept, [key, "idx"], "left").select(key, "idx", F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"), F.col("_line").alias("text"), F.coalesce("_speaker", "_own").alias("speaker"))
