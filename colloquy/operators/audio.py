"""Samples in array columns: mixing, resampling, energy, speech regions; and the segments of recognisers' answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import majority
from .vectors import spectral_speakers


def _div(a: Column, n) -> Column:
    """Whole division towards zero."""
    q = F.floor(F.abs(a) / n)
    return F.when(a < 0, -q).otherwise(q)


def mono(samples: Column, channels: int) -> Column:
    """The mean of interleaved channels, cut towards zero; a last, partial frame has the mean of what it has."""
    if channels == 1:
        return samples
    starts = F.filter(F.sequence(F.lit(0), F.size(samples), F.lit(channels)), lambda i: i < F.size(samples))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return F.transform(starts, lambda i: _div(total(F.slice(samples, i + 1, channels)), F.size(F.slice(samples, i + 1, channels))))


def resampled(samples: Column, rate: int, to: int) -> Column:
    """The sample at or before each new place."""
    if rate == to:
        return samples
    n = F.floor(F.size(samples) / F.lit(rate / to) + 0.5)
    places = F.filter(F.sequence(F.lit(0).cast("long"), n), lambda i: i < n)
    return F.transform(places, lambda i: F.coalesce(F.get(samples, F.floor(i * F.lit(rate / to)).cast("int")), F.lit(0).cast("long")))


def mixed(a: Column, b: Column) -> Column:
    """Half the sum of two recordings, cut towards zero; the shorter one is silent at its end."""
    zero = F.lit(0).cast("long")
    return F.zip_with(a, b, lambda x, y: _div(F.coalesce(x, zero) + F.coalesce(y, zero), 2))


def speech_regions(rows: DataFrame, keys: list[str], rate: int, frame_ms: int = 30, speech_ms: int = 500, silence_ms: int = 600) -> DataFrame:
    """Regions of speech (keys, start, end) in stretches (keys, start, end, samples: those of the stretch) of recordings.

    A frame is speech if its energy (root mean square) is above the 30th percentile plus a quarter of the way to the 95th.
    Silence of silence_ms or more ends a region, which counts if it lasts speech_ms; one that reaches the end of the
    stretch ends with it. A stretch without regions, or of less than a frame, is one region; an empty one has none.
    """
    size, least, gap = int(rate * frame_ms / 1000), max(1, speech_ms // frame_ms), max(1, silence_ms // frame_ms)
    energy = lambda i: F.sqrt(F.aggregate(F.slice("samples", i * size + 1, size), F.lit(0.0), lambda s, x: s + x * x) / size)
    n = F.floor(F.size("samples") / size).cast("int")
    held = rows.filter(F.size("samples") > 0).withColumn("_n", n)
    frames = F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), energy))
    held = held.withColumn("_e", frames).withColumn("_sorted", F.array_sort("_e"))
    at = lambda p: F.get("_sorted", F.floor(F.col("_n") * p).cast("int"))
    held = held.withColumn("_least", at(0.3) + 0.25 * (at(0.95) - at(0.3)))
    loud = held.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to"), "_n", "_least", F.posexplode("_e").alias("_i", "_x")).filter("_x > _least")
    w = Window.partitionBy(*keys, "_from").orderBy("_i")
    loud = loud.withColumn("_new", (F.col("_i") - F.lag("_i").over(w) - 1 >= gap).cast("int")).withColumn("_g", F.sum(F.coalesce("_new", F.lit(0))).over(w))
    found = loud.groupBy(*keys, "_from", "_to", "_n", "_g").agg(F.min("_i").alias("a"), (F.max("_i") + 1).alias("b"))
    open_end = F.col("_n") - F.col("b") < gap
    found = found.withColumn("b", F.when(open_end, F.col("_n")).otherwise(F.col("b"))).filter(F.col("b") - F.col("a") >= least)
    second = frame_ms / 1000
    end = F.when(F.col("b") == F.col("_n"), F.col("_to")).otherwise(F.least(F.col("_from") + F.col("b") * second, F.col("_to")))
    regions = found.select(*keys, "_from", (F.col("_from") + F.col("a") * second).alias("start"), end.alias("end"))
    whole = held.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to")).join(regions.select(*keys, "_from").distinct(), [*keys, "_from"], "left_anti")
    return regions.drop("_from").unionByName(whole.select(*keys, F.col("_from").alias("start"), F.col("_to").alias("end")))


def segment_parts(segments: DataFrame, keys: list[str], rate: int, most: float = 5.0, **limits) -> DataFrame:
    """(keys, start, end): what a speaker is told by. Segments (start, end, samples) of more than `most` seconds are cut to their regions of
    speech (speech_regions(), with its limits); others, and those of unknown length, stay whole."""
    long = F.coalesce(F.col("end") - F.col("start") > most, F.lit(False))
    return segments.filter(~long).select(*keys, "start", "end").unionByName(speech_regions(segments.filter(long), keys, rate, **limits))


def diarised(parts: DataFrame, recording: str, segment: str, clusters: int | None = None) -> DataFrame:
    """Speakers of segments from their parts (recording, segment, part, embedding): spectral clusters of a recording's parts, then the
    most frequent one of each segment, the first of equals. A recording with fewer than two embeddings has no speakers."""
    enough = parts.groupBy(recording).agg(F.count("embedding").alias("_n")).filter("_n >= 2").select(recording)
    parts = parts.join(enough, recording, "left_semi")
    named = spectral_speakers(parts, [recording], "part", "embedding", clusters).filter("speaker is not null")
    placed = parts.select(recording, "part", segment).join(named, [recording, "part"])
    return majority(placed, [recording, segment], "speaker", "part").drop("votes")


SENTENCES = "array<struct<text:string,sentence_info:array<struct<text:string,start:double,end:double>>>>"


def sentence_segments(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, idx, start, end, text) of answers with sentences timed in milliseconds; an item without sentences is one segment without
    times, if it has text."""
    item = lambda x: F.when(F.coalesce(F.size(x["sentence_info"]), F.lit(0)) > 0, F.transform(x["sentence_info"], lambda s: F.struct(F.round(F.coalesce(s["start"], F.lit(0.0)) / 1000, 3).alias("start"), F.round(F.coalesce(s["end"], F.lit(0.0)) / 1000, 3).alias("end"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text")))).otherwise(F.filter(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.trim(F.coalesce(x["text"], F.lit(""))).alias("text"))), lambda s: s["text"] != ""))
    rows = answers.select(key, F.posexplode(F.flatten(F.transform(F.from_json(body, SENTENCES), item))).alias("idx", "s"))
    return rows.select(key, "idx", "s.start", "s.end", "s.text")


def recognised_segments(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, format, idx, start, end, text, speaker, confidence) of recognisers' JSON answers, whatever format each row has:

    `sentences`: a list of items with sentence_info in milliseconds, or a text; `verbose`: segments in seconds, with a mean log
    probability; `output`: output.sentence in milliseconds, with speaker ids; `chunks`: pairs of seconds, or a text.
    A row is parsed once, into a variant, and its paths tell its format. Rows that are no JSON, or of no format, have no segments. Blank
    chunks and texts are left out, as are items without sentences and text.
    """
    v, none = F.col("_v"), lambda kind: F.lit(None).cast(kind)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    seconds = lambda c, by=1: F.round(F.coalesce(c, F.lit(0.0)) / by, 3)

    def segment(start: Column, end: Column, text: Column, speaker: Column | None = None, confidence: Column | None = None) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), F.trim(F.coalesce(text, F.lit(""))).alias("text"), (none("string") if speaker is None else speaker).alias("speaker"), (none("double") if confidence is None else confidence).alias("confidence"))

    def untimed(text: Column) -> Column:
        return F.filter(F.array(segment(F.lit(0.0), F.lit(0.0), text)), lambda s: s["text"] != "")

    items = F.coalesce(at("$", SENTENCES), F.array().cast(SENTENCES))
    sentences = F.flatten(F.transform(items, lambda x: F.when(F.coalesce(F.size(x["sentence_info"]), F.lit(0)) > 0, F.transform(x["sentence_info"], lambda s: segment(seconds(s["start"], 1000), seconds(s["end"], 1000), s["text"]))).otherwise(untimed(x["text"]))))
    log = lambda s: F.when(s["avg_logprob"] != 0, F.round(s["avg_logprob"], 3))
    verbose = F.transform(at("$.segments", "array<struct<start:double,end:double,text:string,avg_logprob:double>>"), lambda s: segment(seconds(s["start"]), seconds(s["end"]), s["text"], confidence=log(s)))
    said = F.transform(at("$.output.sentence", "array<struct<begin_time:double,end_time:double,text:string,speaker_id:string>>"), lambda s: segment(seconds(s["begin_time"], 1000), seconds(s["end_time"], 1000), s["text"], speaker=F.concat(F.lit("Speaker_"), s["speaker_id"])))
    pairs = F.filter(F.transform(at("$.chunks", "array<struct<timestamp:array<double>,text:string>>"), lambda s: segment(seconds(F.get(s["timestamp"], F.lit(0))), seconds(F.coalesce(F.get(s["timestamp"], F.lit(1)), F.get(s["timestamp"], F.lit(0)))), s["text"])), lambda s: s["text"] != "")
    chunks = F.when(F.coalesce(F.size(at("$.chunks", "array<variant>")), F.lit(0)) > 0, pairs).otherwise(untimed(at("$.text", "string")))
    formats = [("sentences", F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), sentences), ("verbose", at("$.segments", "variant").isNotNull(), verbose), ("output", at("$.output.sentence", "variant").isNotNull(), said), ("chunks", at("$.chunks", "variant").isNotNull() | at("$.text", "variant").isNotNull(), chunks)]
    name, found = none("string"), none("array<struct<start:double,end:double,text:string,speaker:string,confidence:double>>")
    for kind, is_it, segments in reversed(formats):
        name, found = F.when(is_it, F.lit(kind)).otherwise(name), F.when(is_it, segments).otherwise(found)
    rows = answers.select(key, F.try_parse_json(body).alias("_v")).select(key, name.alias("format"), F.posexplode(found).alias("idx", "s"))
    return rows.select(key, "format", "idx", "s.*")


def chunk_segments(rows: DataFrame, chunk: str, seconds: float, length: Column) -> DataFrame:
    """Segments (start, end) of chunks of so many seconds, numbered from 0, in the recording's time; those without times get their
    chunk's, which ends with the recording (length)."""
    begin = F.col(chunk) * F.lit(float(seconds))
    last = F.least(begin + seconds, length) - begin
    start = F.when((F.col("start") > 0) | (F.col("end") > 0), F.col("start")).otherwise(0.0)
    end = F.when(F.col("end") > 0, F.col("end")).otherwise(last)
    return rows.withColumns({"start": F.round(begin + start, 3), "end": F.round(begin + end, 3)})


def map_reduce(rows: DataFrame, key: str, pieces: Column, each: Callable[[Column], Column], merge: Callable[[Column], Column]) -> DataFrame:
    """(key, result): each piece of a row's text by itself, then what the pieces gave, in order, merged. Pieces that fail (null)
    are left out; a row whose pieces all fail is an error."""
    parts = rows.select(key, F.posexplode(pieces).alias("_at", "_piece")).withColumn("_got", each(F.col("_piece")))
    listed = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_got").isNotNull(), F.struct("_at", "_got")))).alias("_l"))
    checked = F.when(F.size("_l") > 0, F.transform("_l", lambda x: x["_got"])).otherwise(F.raise_error(F.lit("every piece failed")))
    return listed.select(key, merge(checked).alias("result"))
