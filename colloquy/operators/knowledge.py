"""The knowledge base: chunks of meetings, their index, search, reranking and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx
from . import blocks
from .relational import with_title
from .vectors import doubles


def segment_chunks(segments: DataFrame, size: int = 500) -> DataFrame:
    """Segments (project_id, idx, start, end, speaker, text) packed in order into chunks of about size characters: (project_id,
    position, text, start_time, end_time, speaker).

    A chunk closes when its text, with a space after each segment, and the next one are longer than size; blank segments
    are skipped. Start and speaker are the first segment's (of the first chunk, the meeting's first); end_time is that of the
    segment that closed the chunk, and the last chunk has none. A long meeting is packed by many tasks.
    """
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = segments.select("project_id", "idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker", said.alias("said"))
    n = F.length("said")
    spoken = n > 0
    room = F.greatest(F.lit(1), size - n + 1)  # a chunk without text yet takes any
    rows = blocks.parts(rows, ["project_id"], ["idx"], F.when(spoken, room), F.when(spoken, n + 1).otherwise(0), F.when(spoken, n + 1).otherwise(0), "position", low=F.lit(0))
    texts = F.transform(F.array_sort(F.collect_list(F.when(spoken, F.struct("idx", "said")))), lambda x: x["said"])
    parts = rows.groupBy("project_id", "position").agg(F.array_join(texts, " ").alias("text"), F.min_by("start", "idx").alias("start_time"), F.min_by("end", "idx").alias("_closes"), F.min_by("speaker", "idx").alias("speaker"))
    after = parts.select("project_id", (F.col("position") - 1).alias("position"), F.col("_closes").alias("end_time"))
    every = parts.filter("text <> ''").join(after, ["project_id", "position"], "left")
    return every.select("project_id", F.col("position").cast("int").alias("position"), "text", "start_time", "end_time", "speaker")


BYTES = 1 << 20  # of texts that a worker holds as Python objects: so many, or one text


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where runs of rows begin and end whose texts have BYTES together, or are one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES, side="right")))
        yield a, b
        a = b


def text_chunks(rows: DataFrame, text: str, position: str, chunk: str) -> DataFrame:
    """rows with, in place of the text, a row for each of its chunks (chunk_text()) and its position. Null texts have none. A worker cuts some texts at
    a time, and hands their chunks on, so what it needs depends on a text's size alone."""
    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(position, T.IntegerType(), False), T.StructField(chunk, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(text)):
                found = [tx.chunk_text(t or "") for t in batch.column(text).slice(a, b - a).to_pylist()]
                size = np.fromiter(map(len, found), np.int64, len(found))
                own = pa.array(np.repeat(np.arange(a, b), size))
                place = pa.array(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), pa.int32())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in kept], place, pa.array(list(chain.from_iterable(found)), pa.string())], names=[*kept, position, chunk])

    return rows.select(*kept, text).mapInArrow(cut, schema)


def index_chunks(projects: DataFrame, segments: DataFrame, summaries: DataFrame, notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """Chunks (project_id, source_type, position, text, metadata_json) of all projects that aren't folders: segments, then
    summaries (raw_markdown, topic), notes (text) and attachments (filename, text)."""
    live = projects.filter(~F.col("is_folder")).select("project_id")
    packed = segment_chunks(segments.join(live, "project_id", "left_semi"))
    meta = F.to_json(F.struct("start_time", "end_time", "speaker"))
    parts = [packed.select("project_id", F.lit("segment").alias("source_type"), "position", "text", meta.alias("metadata_json"))]
    for kind, table, text, metadata in (("summary", summaries, "raw_markdown", F.struct(F.coalesce("topic", F.lit("")).alias("topic"))), ("note", notes, "text", None), ("attachment", attachments, "text", F.struct("filename"))):
        own = table.join(live, "project_id", "left_semi").select("project_id", (F.to_json(metadata) if metadata is not None else F.lit("{}")).alias("metadata_json"), F.col(text).alias("_whole"))
        parts.append(text_chunks(own.withColumn("source_type", F.lit(kind)), "_whole", "position", "text"))
    first, *rest = [p.select("project_id", "source_type", "position", "text", "metadata_json") for p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first


def index_counts(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each project that isn't a folder, and of all of them."""
    counts = projects.filter(~F.col("is_folder")).select("project_id").join(chunks.groupBy("project_id").count(), "project_id", "left")
    return counts.select("project_id", F.coalesce("count", F.lit(0)).alias("chunks"))


def search(chunks: DataFrame, query: Column, projects: DataFrame, k: int, fetch: int | None = None) -> DataFrame:
    """The k nearest chunks (with a vector) to a query vector by distance, ranked, with their project's title."""
    near = F.sqrt(F.aggregate(F.zip_with(doubles(F.col("vector")), query, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    found = chunks.filter(F.size("vector") == F.size(query)).withColumn("score", near).orderBy("score", "project_id", "chunk_id").limit(fetch or k)
    rank = F.row_number().over(Window.orderBy("score", "project_id", "chunk_id"))  # of the rows fetched
    return with_title(found.withColumn("ordinal", rank.cast("long") - 1), projects)


def reranked(found: DataFrame, ranking: DataFrame) -> DataFrame:
    """Found rows (ordinal) in the order of a reranker's answer (rank, ordinal, relevance); ordinals beyond what was found go."""
    return found.drop("score").join(ranking, "ordinal").select("rank", *[c for c in found.columns if c != "score"], F.col("relevance").alias("score")).orderBy("rank")


_RERANKERS: dict = {}


def rerank(found: DataFrame, key: str, question: str, reranker: Callable[[], object], name: str, k: int, retries: int = 2, batch: int = 64) -> DataFrame:
    """The k best hits (key, question, ordinal, text) of each question in a reranker's order: (key, rank, ordinal, text, relevance, fallback).

    `reranker()` makes the object whose rank(list of (question, texts)) gives, for each question, pairs of a text's place and its relevance. A worker makes it
    once, by name. It gets some questions at a time; a call that raises is made again, `retries` times, then question by question, and a question that
    still fails keeps the search's order, without relevance. Places beyond the hits, and places named twice, are left out. A question's hits are what the search
    fetched for it, so they are few.
    """
    hits = F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("hits")
    asked = found.groupBy(key).agg(F.min(question).alias("question"), hits)
    kind = found.schema[key].dataType.simpleString()

    def answered(model, some: list[tuple]) -> list | None:
        for _ in range(retries + 1):
            try:
                got = [list(a) for a in model.rank(some)]
                if len(got) == len(some):
                    return got
            except Exception:  # noqa: S112  whatever the model raises, the question is asked again or keeps its order
                continue
        return None

    def ranked(batches):
        if name not in _RERANKERS:
            _RERANKERS.clear()
            _RERANKERS[name] = reranker()
        model = _RERANKERS[name]
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                some = [(q, [h["text"] for h in hs]) for q, hs in zip(part["question"], part["hits"])]
                whole = answered(model, some)
                each = whole if whole is not None else [(answered(model, [s]) or [None])[0] for s in some]
                rows = []
                for own, hs, answer in zip(part[key], part["hits"], each):
                    fallback = answer is None
                    first: dict[int, float] = {}
                    for i, r in answer or []:
                        if 0 <= int(i) < len(hs):
                            first.setdefault(int(i), float(r))
                    order = [(i, None) for i in range(len(hs))] if fallback else sorted(first.items(), key=lambda x: -x[1])
                    rows += [(own, rank, hs[i]["ordinal"], hs[i]["text"], r, fallback) for rank, (i, r) in enumerate(order[:k])]
                yield pd.DataFrame(rows, columns=[key, "rank", "ordinal", "text", "relevance", "fallback"]).astype({"relevance": "float64"})

    return asked.mapInPandas(ranked, f"`{key}` {kind}, rank long, ordinal long, text string, relevance double, fallback boolean")


def context(hits: DataFrame, key: list[str]) -> DataFrame:
    """The text that a question's search hits (ordinal, project_title, source_type, text) give to a model; `keys` without hits
    are the caller's to add."""
    line = F.concat(F.lit("\n["), "project_title", F.lit(" - "), "source_type", F.lit("]\n"), "text", F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy(*key).agg(F.concat(F.lit("相关内容：\n"), F.array_join(lines, "")).alias("context"))
