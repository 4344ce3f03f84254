"""Operators over ordered segments: islands, sessions, paragraphs, smoothing, offsets, and folds with state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks


def islands(rows: DataFrame, keys: list[str], order: list[str], label: str, name: str = "island") -> DataFrame:
    """Number the runs of equal neighbouring labels (nulls are equal) from 0 within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1)).cast("long")
    return rows.withColumn("_c", changed).withColumn(name, F.sum("_c").over(w)).drop("_c")


def merge_runs(rows: DataFrame, keys: list[str], order: str, label: str, text: str) -> DataFrame:
    """One row per run of one speaker: first and last position, rows, joined texts."""
    numbered = islands(rows, keys, [order], label)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.coalesce(x[text], F.lit(""))), "")
    return numbered.groupBy(*keys, "island").agg(F.first(label).alias(label), F.min(order).alias("first_pos"), F.max(order).alias("last_pos"), F.count(F.lit(1)).alias("n"), joined.alias(text))


def gap_sessions(rows: DataFrame, keys: list[str], order: list[str], start: Column, end: Column, gap: float, name: str = "session") -> DataFrame:
    """Paragraphs by silence: a row starts a new one when it begins more than gap after the previous row's end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((start - F.lag(end).over(w) > gap).cast("long"), F.lit(0))
    return rows.withColumn("_n", new).withColumn(name, F.sum("_n").over(w)).drop("_n")


def mark_boundaries(rows: DataFrame, keys: list[str], order: list[str], paragraph: str, text: str) -> DataFrame:
    """Append a blank line to the last row of each paragraph but the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ends = F.lead(paragraph).over(w) != F.col(paragraph)
    return rows.withColumn(text, F.when(ends, F.concat(F.col(text), F.lit("\n\n"))).otherwise(F.col(text)))


def smooth_labels(rows: DataFrame, keys: list[str], order: str, label: str, reach: int = 2) -> DataFrame:
    """Each row's most frequent original label among its neighbours; of equal ones the earliest; empty ones don't count."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    near = F.filter(F.collect_list(label).over(w), lambda x: x != "")
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    rows = rows.withColumn("_near", near)
    best = F.aggregate("_near", F.struct(F.lit(None).cast("string").alias("l"), F.lit(0).alias("n")), lambda a, x: F.when(count(F.col("_near"), x) > a["n"], F.struct(x.alias("l"), count(F.col("_near"), x).alias("n"))).otherwise(a))
    return rows.withColumn("smoothed", F.coalesce(best["l"], F.col(label))).drop("_near")


def renumber(rows: DataFrame, keys: list[str], order: str, label: str, prefix: str = "Speaker ") -> DataFrame:
    """Names by first appearance: Speaker 1, Speaker 2, ..."""
    first = F.min(order).over(Window.partitionBy(*keys, label))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    return rows.withColumn("_first", first).withColumn("renamed", F.concat(F.lit(prefix), rank.cast("string"))).drop("_first")


def char_offsets(rows: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """The characters before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0)))


def sliding_windows(rows: DataFrame, duration: str, size: float = 3.0, step: float = 1.0) -> DataFrame:
    """Starts of windows of a size every step, whole ones only."""
    last = F.floor((F.col(duration) - size) / step).cast("int")
    starts = F.when(F.col(duration) >= size, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("_k", F.explode(starts)).withColumn("window_start", F.col("_k") * step).drop("_k")


PIECE = 4096  # samples of a recording that lie in one row, or those of one window if it has more


def voiced_windows(rows: DataFrame, keys: list[str], order: str, sample: Column, rate: int, size: float = 3.0, step: float = 1.0, least: float = 0.01) -> DataFrame:
    """Samples of recordings (keys), a row each, in order -> (keys, window_start, rms): the start of each whole window that isn't silent, and its
    root mean square. Null samples count as none.

    A recording is cut into pieces of some windows each, which overlap by a window, so no row or task holds a long one.
    """
    hop, length = step * rate, int(size * rate)
    many = max(int(-(-length // hop)), int(PIECE // hop), 1)  # windows of a piece
    first = lambda k: F.floor(F.round(k * F.lit(step), 9) * rate)  # noqa: E731  sample of a window's start
    placed = blocks.running(rows.select(*keys, order, sample.cast("double").alias("_x")), keys, [order], F.lit(1), "_at")
    near = F.floor(F.col("_at") / (many * hop))
    spread = placed.withColumn("_piece", F.explode(F.sequence(F.greatest(near - 1, F.lit(0)), near + 1)))
    lead = F.col("_piece") * many
    held = spread.filter((F.col("_at") >= first(lead)) & (F.col("_at") < first(lead + many - 1) + length + 2))
    x = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"])
    pieces = held.groupBy(*keys, "_piece").agg(x.alias("_samples"))
    begin = first(lead)
    last = F.least(lead + many - 1, F.floor(((begin + F.size("_samples")) / F.lit(rate) - size) / step))

    def window(k: Column) -> Column:
        own = F.filter(F.slice("_samples", (first(k) - begin).cast("int") + 1, length), lambda v: v.isNotNull())
        return F.struct((k * F.lit(step)).alias("window_start"), F.sqrt(F.try_divide(F.aggregate(own, F.lit(0.0), lambda s, v: s + v * v), F.size(own))).alias("rms"))

    windows = F.transform(F.sequence(lead, last), window)
    found = pieces.filter(last >= lead).select(*keys, F.explode(F.filter(windows, lambda w: w["rms"] >= least)).alias("_w"))
    return found.select(*keys, "_w.window_start", "_w.rms")


def sentence_split_needed(segments: DataFrame, turns: DataFrame, keys: list[str], share: float = 0.8, times: float = 2.0) -> DataFrame:
    """(keys, split): whether a meeting's segments are to be cut into sentences: more than a share of them have no duration, or they
    are on average more than so many times as long as the speakers' turns (start, end; none count as 0)."""
    length = F.col("end") - F.col("start")
    own = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(length < 0.01).alias("_none"), F.avg(length).alias("_mean"))
    turn = turns.groupBy(*keys).agg(F.avg(length).alias("_turn"))
    split = (F.col("_none") > F.col("_n") * share) | (F.col("_mean") > F.coalesce("_turn", F.lit(0.0)) * times)
    return own.join(turn, keys, "left").select(*keys, split.alias("split"))


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a sequential step to each key's rows in order. A key is one meeting: its rows are bounded by its length."""
    return rows.groupBy(*keys).applyInPandas(lambda pdf: step(pdf.sort_values(order, kind="stable").reset_index(drop=True)), schema)


def paragraphs(starts, ends, texts, markers: tuple[str, ...], mode: str, gap: float = 1.5, least: float = 5.0, most: float = 60.0) -> list[int]:
    """Paragraph numbers of one meeting's segments: by a topic marker after two segments (semantic), or by silence,
    marker or length once enough speech has gathered (hybrid)."""
    out, number, size, speech, last_end = [], 0, 0, 0.0, None
    for s, e, t in zip(starts, ends, texts):
        marked = any(m in (t or "") for m in markers)
        if size:
            split = marked and size >= 2 if mode == "semantic" else (s - last_end > gap or marked or speech >= most) and speech >= least
            if split:
                number, size, speech = number + 1, 0, 0.0
        size, speech, last_end = size + 1, speech + (e - s), e
        out.append(number)
    return out


def char_similarity(a: str, b: str) -> float:
    """Shared characters, with multiplicity, over the longer length; an empty text is only like an empty one."""
    if not a or not b or a == b:
        return float(a == b)
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def repeated_runs(texts: list[str], similar: Callable[[str, str], float], ratio: float, least: int) -> list[bool]:
    """Flags all but the first of each run of near-equal texts (compared to the run's first) of at least so many; empty texts
    found no run."""
    flags, head = [False] * len(texts), 0
    while head < len(texts):
        i = head + 1
        while texts[head] and i < len(texts) and similar(texts[head], texts[i]) >= ratio:
            i += 1
        if i - head >= least:
            flags[head + 1 : i] = [True] * (i - head - 1)
        head = i
    return flags


def time_flags(rows: DataFrame, keys: list[str], order: list[str], longest: float, most: float, name: str = "odd") -> DataFrame:
    """Flags segments of negative or too long duration, and those that overlap the one before by more than a share of the shorter,
    unless that one is flagged. Segments without duration overlap nothing.

    A flag depends on the one before only within a run of overlapping segments, where flags take turns: so the distance to
    the run's beginning settles each, by windows and without a fold.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    length = F.col("end") - F.col("start")
    prev = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"_bad": F.coalesce((length < 0) | (length > longest), F.lit(False)), "_n": F.row_number().over(w), "_prev": prev(length), "_past": F.greatest(prev("end") - F.col("start"), F.lit(0.0))})
    rows = rows.withColumn("_over", ~F.col("_bad") & F.coalesce((F.col("_prev") > 0) & (length > 0) & (F.try_divide("_past", F.least("_prev", length)) > most), F.lit(False)))
    begin = F.last(F.when(~F.col("_over"), F.struct("_n", "_bad")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_begin", begin)
    odd = ((F.col("_n") - F.col("_begin._n")) % 2 == 1) != F.col("_begin._bad")
    return rows.withColumn(name, odd).drop("_bad", "_n", "_prev", "_past", "_over", "_begin")


def merge_windows(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Neighbouring windows (start, end) of one label become one; windows without a label are left out first."""
    numbered = islands(rows.filter(F.col(label).isNotNull()), keys, ["start", "end"], label)
    return numbered.groupBy(*keys, "island").agg(F.first(label).alias(label), F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def paragraph_bounds(rows: DataFrame, keys: list[str], order: str, paragraph: str) -> DataFrame:
    """The start of each paragraph's first and the end of its last segment."""
    return rows.groupBy(*keys, paragraph).agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"))


def keep_prefix(old: DataFrame, new: DataFrame, keys: list[str], start: str = "start") -> DataFrame:
    """Segments of old before the first of new, followed by new; meetings that new doesn't have stay whole."""
    first = new.groupBy(*keys).agg(F.min(start).alias("_first"))
    prefix = old.join(first, keys, "left").filter(F.col("_first").isNull() | (F.col(start) < F.col("_first"))).drop("_first")
    return prefix.unionByName(new)


def pack_lines(lengths, limit: int, joiner: int = 1) -> list[int]:
    """Greedy packing: chunk numbers of lines such that each chunk has at most limit characters, or one line."""
    out, number, size = [], 0, None
    for n in lengths:
        if size is None:
            size = n
        elif size + joiner + n > limit:
            number, size = number + 1, n
        else:
            size += joiner + n
        out.append(number)
    return out


def aligner_windows(starts, ends, most: float = 240.0) -> list[int]:
    """Window numbers of one recording's sentences: a window takes sentences while the last one ends within so many seconds of the
    window's start."""
    out, number, begin = [], 0, None
    for s, e in zip(starts, ends):
        if begin is not None and e - begin > most:
            number, begin = number + 1, s
        begin = s if begin is None else begin
        out.append(number)
    return out


def window_bounds(rows: DataFrame, keys: list[str], window: str, length: Column, margin: float = 5.0) -> DataFrame:
    """The stretch of the recording that each window is aligned on, with a margin on both sides."""
    bounds = rows.groupBy(*keys, window).agg(F.min("start").alias("a"), F.max_by("end", "start").alias("b"), F.max(length).alias("_length"))
    return bounds.select(*keys, window, F.greatest(F.col("a") - margin, F.lit(0.0)).alias("start"), F.least(F.col("b") + margin, F.col("_length")).alias("end"))
