"""Folds over ordered rows without one task a meeting: blocks as step functions, composed, then finished in parallel.

The folds of this library cut a meeting's rows into parts, and carry one number from row to row: a row that finds the number at or
above its threshold begins a new part and sets it; any other row adds to it. Packing lines, paragraphs by speech, markers or silence,
and windows of a recording are of this kind, with other thresholds.

Rows are range-partitioned by key and order, so a long meeting lies on many tasks. Each block of rows is one record, with what it does
to any number that comes in: the first row that cuts depends on the number by a step function, and what follows that row on the
row alone. Of these small tables, not of rows, a meeting's are composed in order; with the number that enters each block, all
blocks number their rows independently.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.shared import written

ROWS = 4096  # of a block, at most
NEVER = float("inf")
TABLE = "block long, at array<double>, cuts array<long>, leaves array<double>, total double, first_cuts long, first_leaves double"


def block_table(threshold: list[float], add: list[float], reset: list[float], low: float) -> tuple[list[float], list[int], list[float], float, int, float]:
    """What a block does to a number that enters: its steps (the least number at which a row cuts first, how many rows cut from there on,
    and the number that leaves), the sum it adds where none cuts, and cuts and number if its first row cuts in any case.

    Steps below `low`, than which no number is smaller, are left out.
    """
    n = len(add)
    before = np.concatenate([[0.0], np.cumsum(add)]).tolist()
    at, rows = [], []  # steps, seen from the row that is reached: the nearest row last, its step the greatest
    cuts, leaves = [0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        k = bisect_right(at, reset[i] - before[i + 1]) - 1  # the first row beyond that cuts what row i has set
        if k >= 0:
            cuts[i], leaves[i] = cuts[rows[k]] + 1, leaves[rows[k]]
        else:
            leaves[i] = reset[i] + before[n] - before[i + 1]
        step = threshold[i] - before[i]
        while at and at[-1] >= step:
            at.pop()
            rows.pop()
        at.append(step)
        rows.append(i)
    least = max(0, bisect_right(at, low) - 1)
    at, rows = at[least:], rows[least:]
    return at, [cuts[i] + 1 for i in rows], [leaves[i] for i in rows], before[n], cuts[0], leaves[0]


def through(tables: list[dict]) -> list[tuple[int, float | None, int]]:
    """A meeting's block tables, in order -> (block, number that enters, parts begun before; none before the first)."""
    out, number, parts = [], None, 0
    for t in tables:
        out.append((t["block"], number, parts))
        if number is None:
            number, parts = t["first_leaves"], t["first_cuts"]
            continue
        k = bisect_right(t["at"], number) - 1
        number, parts = (t["leaves"][k], parts + t["cuts"][k]) if k >= 0 else (number + t["total"], parts)
    return out


def numbered(threshold: list[float], add: list[float], reset: list[float], number: float | None, part: int) -> list[int]:
    """The part of each row of a block, by the plain fold; without a number, the first row begins the meeting."""
    out = []
    for t, a, r in zip(threshold, add, reset):
        if number is None:
            number = r
        elif number >= t:
            number, part = r, part + 1
        else:
            number += a
        out.append(part)
    return out


def _payload(rows: DataFrame, keys: list[str], order: list[str], name: str, *extra: Column) -> tuple[DataFrame, list[str]]:
    """Keys as k0..., the other columns as struct `row`, and what a fold needs, range-partitioned and sorted by key and order."""
    own, last = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != name]).alias("row")
    chosen = rows.select(*[F.col(f"`{c}`").alias(o) for c, o in zip([*keys, *order], [*own, *last])], row, *extra)
    return chosen.repartitionByRange(*own, *last).sortWithinPartitions(*own, *last).drop(*last), own


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where a batch's runs of equal keys begin, cut at ROWS, and its end."""
    new = np.zeros(len(batch), bool)
    new[::ROWS] = True
    for k in keys:
        coded = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= coded[1:] != coded[:-1]
    return [*np.flatnonzero(new).tolist(), len(batch)]


def parts(rows: DataFrame, keys: list[str], order: list[str], threshold: Column, add: Column, reset: Column, name: str, low: Column | None = None) -> DataFrame:
    """rows with the number (from 0) of the part that each lies in, within its key and in order.

    A key's first row begins part 0 and sets the carried number to `reset`. Of the others, in order, one that finds it at or above
    `threshold` (null: never) begins a part and sets it to `reset`; otherwise `add` is added. All three are numbers of the row; sums are
    exact below 2^53 in whole numbers. `low`, a number of the row, is a bound below every number carried to it; it keeps blocks'
    tables small. Ties in order stay in any, but one, order; null keys are one key; an empty table gives an empty table.
    """
    numbers = F.coalesce(threshold.cast("double"), F.lit(NEVER)).alias("t"), add.cast("double").alias("a"), reset.cast("double").alias("r"), (F.lit(-NEVER) if low is None else low).cast("double").alias("low")
    ranged, own = _payload(rows, keys, order, name, *numbers)
    doubles = T.ArrayType(T.DoubleType())
    held = T.StructType([*[T.StructField(o, ranged.schema[o].dataType) for o in own], T.StructField("rows", T.ArrayType(ranged.schema["row"].dataType)), *[T.StructField(c, doubles) for c in "tar"], *T.StructType.fromDDL(TABLE).fields])

    def blocks(batches):
        number = TaskContext.get().partitionId() << 32  # blocks of ascending number are in order
        for batch in batches:
            if not len(batch):
                continue
            cut = _runs(batch, own)
            t, a, r = (batch.column(c).to_pylist() for c in "tar")
            low = batch.column("low").to_pylist()
            tables = [block_table(t[x:y], a[x:y], r[x:y], low[x]) for x, y in zip(cut, cut[1:])]
            ends = pa.array(cut, pa.int32())
            first = pa.array(cut[:-1])
            columns = [batch.column(o).take(first) for o in own] + [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("row", *"tar")]
            ids = pa.array(range(number, number + len(tables)), pa.int64())
            number += len(tables)
            kinds = (pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.float64())
            columns += [ids, *[pa.array([x[k] for x in tables], kind) for k, kind in enumerate(kinds)]]
            yield pa.RecordBatch.from_arrays(columns, names=held.names)

    records = written(ranged.mapInArrow(blocks, held), "blocks")
    names = [f.name for f in T.StructType.fromDDL(TABLE).fields]
    every = records.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("tables")).filter(F.size("tables") > 1).select("tables")

    def states(batches):
        for batch in batches:
            found = [s for x in batch.column("tables").to_pylist() for s in through(x)]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in found], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["block", "number", "part"])

    entering = every.mapInArrow(states, "block long, number double, part long")
    ready = records.select("block", "rows", *"tar").join(entering, "block", "left")
    fields = records.schema["rows"].dataType.elementType.fields

    def finish(batches):
        for batch in batches:
            given = [batch.column(c).to_pylist() for c in (*"tar", "number", "part")]
            flat = batch.column("rows").flatten()
            number = pa.array([p for t, a, r, n, k in zip(*given) for p in numbered(t, a, r, n, k or 0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*flat.flatten(), number], names=[*[f.name for f in fields], name])

    return ready.mapInArrow(finish, T.StructType([*fields, T.StructField(name, T.LongType())]))


def running(rows: DataFrame, keys: list[str], order: list[str], add: Column, name: str) -> DataFrame:
    """rows with the sum of `add` (whole numbers) over the rows before, in its key and order.

    Rows are range-partitioned by key and order. Sums run within a key's part of a range, after the sums of its parts in the ranges before; a range
    begins in the middle of one key at most, so these sums are no more than ranges. Null keys are one key.
    """
    ranged = rows.withColumn("_add", F.coalesce(add.cast("long"), F.lit(0))).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged").withColumn("_span", F.shiftright("_id", 33))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_span", *keys).agg(F.sum("_add").alias("_sum"))
    cut = sums.withColumn("_before", F.sum("_sum").over(earlier(*keys).orderBy("_span"))).filter("_before <> 0")
    cut = cut.select(F.col("_span").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = [F.col("_span") == F.col("_s"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]]
    own = held.withColumn("_own", F.coalesce(F.sum("_add").over(earlier("_span", *keys).orderBy("_id")), F.lit(0)))
    return own.join(F.broadcast(cut), same, "left").select(*[F.col(c) for c in rows.columns if c != name], (F.col("_own") + F.coalesce("_before", F.lit(0))).alias(name))


def micros(seconds: Column) -> Column:
    """Seconds in whole microseconds, of which sums are exact in any order."""
    return F.round(seconds * 1_000_000)


def paragraphs(rows: DataFrame, keys: list[str], order: list[str], marked: Column, mode: str, gap: Column | None = None, least: float = 5.0, most: float = 60.0, name: str = "paragraph") -> DataFrame:
    """Paragraphs: by a topic marker after two segments (semantic), or by silence before a segment (`gap`), marker or length once
    `least` seconds of speech have gathered (hybrid; columns start and end)."""
    if mode == "semantic":
        return parts(rows, keys, order, F.when(marked, 2), F.lit(1), F.lit(1), name, low=F.lit(1))
    speech = micros(F.col("end") - F.col("start"))
    short = marked | gap if gap is not None else marked
    return parts(rows, keys, order, F.when(short, least * 1e6).otherwise(max(least, most) * 1e6), speech, speech, name)


def packed(rows: DataFrame, keys: list[str], order: list[str], length: Column, limit: int, joiner: int = 1, name: str = "chunk") -> DataFrame:
    """Greedy packing of lines: each part has at most limit characters, with joiners between lines, or is one line."""
    return parts(rows, keys, order, limit - joiner - length + 1, length + joiner, length, name, low=F.lit(0))


def recording_windows(rows: DataFrame, keys: list[str], order: list[str], most: float = 240.0, name: str = "window") -> DataFrame:
    """Windows that take sentences (start, end) while the last one ends within so many seconds of the window's start; rows in the
    order of their starts."""
    begin = -micros(F.col("start"))
    return parts(rows, keys, order, F.lit(most * 1e6) - micros(F.col("end")) + 1, F.lit(0), begin, name, low=begin)




# --- runs of like texts ----------------------------------------------------------------------------------------------


def run_numbers(texts: list[str], similar: Callable[[str, str], float], ratio: float, head: str | None) -> tuple[list[int], str]:
    """How many runs have begun at each text since the block's start, and the text that heads the last one. A text that is unlike the
    head begins a run; so does any after an empty head. Without a head, the first text begins the meeting, and isn't counted."""
    out, begun = [], 0
    for text in texts:
        if head is None:
            head = text
        elif not head or similar(head, text) < ratio:
            head, begun = text, begun + 1
        out.append(begun)
    return out, head


def like_runs(rows: DataFrame, keys: list[str], order: list[str], text: Column, similar: Callable[[str, str], float], ratio: float, name: str = "run") -> DataFrame:
    """rows with the number (from 0) of the run of like texts that each lies in: a run takes texts that are like its first one.

    What a block does depends on the text that heads the run before it, which no table can hold for all texts. So blocks are
    folded at once as if each began with a run, and those that turn out to be entered by another head are folded again,
    until all agree with the blocks before them. A head seldom reaches far into a block, and where it does, as in a long run of
    one text, its text is that of the block's own head: two rounds settle almost all. Null texts are empty.
    """
    ranged, own = _payload(rows, keys, order, name, F.coalesce(text, F.lit("")).alias("text"))
    texts = T.ArrayType(T.StringType())
    held = T.StructType([*[T.StructField(o, ranged.schema[o].dataType) for o in own], T.StructField("rows", T.ArrayType(ranged.schema["row"].dataType)), T.StructField("texts", texts), T.StructField("block", T.LongType())])

    def blocks(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if len(batch):
                cut = _runs(batch, own)
                ends, first = pa.array(cut, pa.int32()), pa.array(cut[:-1])
                ids = pa.array(range(number, number + len(first)), pa.int64())
                number += len(first)
                yield pa.RecordBatch.from_arrays([*[batch.column(o).take(first) for o in own], *[pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("row", "text")], ids], names=held.names)

    def fold(batches):
        for batch in batches:
            given = zip(batch.column("texts").to_pylist(), batch.column("entered").to_pylist())
            found = [run_numbers(x, similar, ratio, head) for x, head in given]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("entered"), pa.array([f[1] for f in found], pa.string()), pa.array([f[0][-1] for f in found], pa.int64())], names=["block", "entered", "leaves", "begun"])

    folded = "block long, entered string, leaves string, begun long"
    records = written(ranged.mapInArrow(blocks, held), "texts")
    where = records.select(*own, "block")
    states = written(records.select("block", "texts", F.lit(None).cast("string").alias("entered")).mapInArrow(fold, folded), "runs")
    before = Window.partitionBy(*own).orderBy("block")
    while True:
        seen = states.join(where, "block").withColumn("head", F.lag("leaves").over(before))
        again = written(seen.filter(~F.col("head").eqNullSafe(F.col("entered"))).select("block", "head"), "again")
        if again.isEmpty():
            break
        redone = records.select("block", "texts").join(again.withColumnRenamed("head", "entered"), "block").mapInArrow(fold, folded)
        states = written(states.join(again, "block", "left_anti").unionByName(redone), "runs")
    part = F.coalesce(F.sum("begun").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part")
    ready = records.select("block", "rows", "texts").join(states.join(where, "block").select("block", "entered", part), "block")
    fields = records.schema["rows"].dataType.elementType.fields

    def finish(batches):
        for batch in batches:
            given = zip(*[batch.column(c).to_pylist() for c in ("texts", "entered", "part")])
            number = pa.array([n + part for x, head, part in given for n in run_numbers(x, similar, ratio, head)[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.column("rows").flatten().flatten(), number], names=[*[f.name for f in fields], name])

    return ready.mapInArrow(finish, T.StructType([*fields, T.StructField(name, T.LongType())]))


def repeated(rows: DataFrame, keys: list[str], order: str, text: Column, similar: Callable[[str, str], float], ratio: float, least: int, name: str = "repeated") -> DataFrame:
    """Flags all but the first row of each run of like texts that has `least` rows at least. Sizes of runs are partial sums, and a
    long meeting's runs are many keys. `order` tells the rows of a key apart."""
    runs = like_runs(rows.drop(name), keys, [order], text, similar, ratio, "_run")
    sizes = runs.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_run").alias("_same")).agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first")).filter(F.col("_size") >= least)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    flag = F.coalesce(F.col(order) > F.col("_first"), F.lit(False)).alias(name)
    return runs.join(sizes, [F.col("_run") == F.col("_same"), *same], "left").select(*[c for c in runs.columns if c != "_run"], flag)
