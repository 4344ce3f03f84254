"""Joins of times and intervals within a meeting, with nearest fallbacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed


SPAN = 60.0  # seconds; a turn is held against the points of each span it touches


def _containing(points: DataFrame, turns: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys, idx, inside): the turn (speaker, pos) that holds each point, the greatest in the order; turns meet points by span of time."""
    at = lambda c: F.floor(F.col(c) / SPAN)
    spread = turns.filter("start <= end").withColumn("_span", F.explode(F.sequence(at("start"), at("end"))))
    held = points.withColumn("_span", at("t")).join(spread, [*keys, "_span"]).filter("start <= t and t <= end")
    return held.groupBy(*keys, "idx").agg(F.max_by(F.struct("speaker", "pos"), order).alias("inside"))


def _neighbours(points: DataFrame, events: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """points with `before` and `after`: the last of the events (at, seq, what) up to t (before it, if strict) and the first one
    beyond; of equal times the last and the first by seq. One sort each way, and running values."""
    mark = 1 if strict else -1
    both = points.select(*keys, "idx", F.col("t").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(events.schema["what"].dataType).alias("what"))
    both = both.unionByName(events.select(*keys, F.lit(None).cast(points.schema["idx"].dataType).alias("idx"), F.col("at").cast("double"), F.lit(mark).alias("kind"), F.col("seq").cast("long"), "what"))
    running = lambda *order: F.last("what", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("before", running("at", "kind", "seq")).withColumn("after", running(F.desc("at"), F.desc("kind"), F.desc("seq")))
    return both.filter("kind = 0").select(*keys, "idx", F.col("at").alias("t"), "before", "after")


def assign_turns(points: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, idx, t) with the speaker of the turn (start, end, pos, speaker) that holds t: of several, the one that starts
    last (then, that comes last). Where none does, the nearer of the two turns around t in order of start, the earlier of equals.
    Meetings without turns leave the speaker null."""
    inside = _containing(points, turns, keys, F.struct("start", "pos"))
    near = _neighbours(points, turns.select(*keys, F.col("start").alias("at"), F.col("pos").alias("seq"), F.struct("start", "end", "speaker").alias("what")), keys, False)
    far = lambda c: F.least(F.abs(F.col("t") - F.col(f"{c}.start")), F.abs(F.col("t") - F.col(f"{c}.end")))
    nearest = F.when(F.col("after").isNull() | (far("before") <= far("after")), F.col("before.speaker")).otherwise(F.col("after.speaker"))
    return near.join(inside, [*keys, "idx"], "left").select(*keys, "idx", "t", F.when(F.col("inside").isNotNull(), F.col("inside.speaker")).otherwise(nearest).alias("speaker"))


def assign_turns_linear(points: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """As assign_turns(), but by the order of the list: the first turn that holds t, else the nearest of all, the first of equals."""
    inside = _containing(points, turns, keys, -F.col("pos"))
    edges = turns.select(*keys, F.explode(F.array("start", "end")).alias("at"), "pos", "speaker")
    edges = edges.groupBy(*keys, "at").agg(F.min(F.struct("pos", "speaker")).alias("first"))
    edges = edges.select(*keys, "at", F.col("first.pos").alias("seq"), F.struct("at", "first.pos", "first.speaker").alias("what"))
    near = _neighbours(points, edges, keys, False)
    left, right = F.col("t") - F.col("before.at"), F.col("after.at") - F.col("t")
    nearest = F.when(F.col("after").isNull() | (left < right) | ((left == right) & (F.col("before.pos") <= F.col("after.pos"))), F.col("before.speaker")).otherwise(F.col("after.speaker"))
    return near.join(inside, [*keys, "idx"], "left").select(*keys, "idx", "t", F.when(F.col("inside").isNotNull(), F.col("inside.speaker")).otherwise(nearest).alias("speaker"))


def assign_speakers(segments: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, idx, start, end, speaker) with the speaker at their middle; where there is none, their own stays."""
    middle = assign_turns(segments.select(*keys, "idx", ((F.col("start") + F.col("end")) / 2).alias("t")), turns, keys)
    found = middle.select(*keys, "idx", F.col("speaker").alias("_found"))
    return segments.join(found, [*keys, "idx"], "left").withColumn("speaker", F.coalesce("_found", "speaker")).drop("_found")


def nearest_segment(segments: DataFrame, keys: list[str], time: float) -> DataFrame:
    """The segment whose start is nearest to a time; the first of equally near ones."""
    return segments.groupBy(*keys).agg(F.min_by("idx", F.struct(F.abs(F.col("start") - time), "idx")).alias("idx"))


def interpolate(points: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Piecewise-linear times of character positions (keys, idx, at) from anchors (pos, time); outside the anchors the nearest
    one's, and of anchors at one position the first one's time."""
    events = anchors.select(*keys, F.col("pos").alias("at"), F.row_number().over(Window.partitionBy(*keys, "pos").orderBy("time")).alias("seq"), F.struct("pos", "time").alias("what"))
    near = _neighbours(points.withColumn("t", F.col("at").cast("double")), events, keys, True)
    mid = F.col("before.time") + (F.col("after.time") - F.col("before.time")) * F.try_divide(F.col("t") - F.col("before.pos"), F.col("after.pos") - F.col("before.pos"))
    return near.select(*keys, "idx", F.col("t").alias("at"), F.coalesce(F.when(F.col("after.pos") == F.col("t"), F.col("after.time")), mid, "before.time", "after.time").alias("time"))


def common_length(a: str, b: str, most: int = 20) -> int:
    """The length of the longest string that both hold; longer ones than `most` count as that. Texts that share a string share all its parts,
    so lengths are halved in on, each by the set of one text's strings of that length."""
    low, high = 0, min(len(a), len(b), most)
    while low < high:
        n = (low + high + 1) // 2
        held = {a[i : i + n] for i in range(len(a) - n + 1)}
        low, high = (n, high) if any(b[i : i + n] in held for i in range(len(b) - n + 1)) else (low, n - 1)
    return low


def locate(items: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """items (key, item, text) with the start of the segment (key, idx, start, text) of their meeting that says most of them: the
    lengths of the item's long words that it holds, and twice that of the longest string they share; the first of equals, none for 0."""

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common_length(x, y) for x, y in zip(a, b)])

    words = F.array_distinct(F.concat(F.regexp_extract_all("_a", F.lit(fixed.PHRASE_ZH), F.lit(0)), F.regexp_extract_all("_a", F.lit("[a-z]{4,}"), F.lit(0))))
    both = items.select(key, "item", F.lower("text").alias("_a")).join(segments.select(key, "idx", "start", F.lower("text").alias("_b")), key)
    said = F.aggregate(F.filter(words, lambda w: F.contains(F.col("_b"), w)), F.lit(0), lambda s, w: s + F.length(w))
    scored = both.withColumn("_score", said + 2 * shared(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit("")))).filter("_score > 0")
    best = scored.groupBy(key, "item").agg(F.max_by("start", F.struct("_score", -F.col("idx"))).alias("start"))
    return items.join(best, [key, "item"], "left")
