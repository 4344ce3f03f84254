"""Suffix-array dedup: windows of `threshold` bytes that start anywhere else too, by depth-limited radix passes.

A depth-limited radix sort would put suffixes (the starts of all windows) in order by their first `threshold` bytes, most
significant digit first, dropping each as soon as its group has one member; groups left after the last digit are
exactly the repeated windows. That takes a row for each byte, far beyond the disk there is, so this departs from it: only
equality counts here, not order, and digits are taken from the inside of the window outwards, as digests of bytes:

1. Digit one is a block of ANCHOR bytes, chosen by content: the least block hash within the window (the leftmost of
   equal ones). Equal windows choose equal blocks at equal offsets, and about 170 neighbouring windows share a block,
   so one row per block stands for all of them. Blocks found once leave.
2. Digit two is all that windows of this block can hold: the bytes before and after it. Groups of two or more are
   equal throughout, hence all their windows are repeated, and they leave as resolved.
3. What is left (blocks at the ends of repeated passages) goes on window by window.

Groups are counted by pairs of 64-bit digests of the bytes (of the block, and of the slice), with partial sums before each shuffle, so a passage that a third
of all documents share costs one row per task. No step collects a group, and matches never cross documents because
windows don't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, materialize, semi_join, text_of, without
from .hashing import mixed, numbers, powers

ANCHOR = 64
OUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans", "kept_text"]


class Rolling:
    """Digests of any slices of data, from prefix sums of byte numbers times powers of a base (modulo 2**64)."""

    def __init__(self, data: bytes):
        a = np.frombuffer(data, np.uint8)
        up, self.down = powers(1 << max(12, len(a).bit_length()))
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(numbers()[a] * up[: len(a)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def blocks(self) -> np.ndarray:
        """The digests of all ANCHOR-byte slices."""
        return mixed((self.sums[ANCHOR:] - self.sums[:-ANCHOR]) * self.down[: len(self.sums) - ANCHOR] + np.uint64(ANCHOR))


def anchors(h: np.ndarray, windows: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks that windows choose: the place of each, and the first and last of the windows that choose it."""
    padded = np.concatenate([h, np.full(-len(h) % wide, np.uint64(2**64 - 1))]).reshape(-1, wide)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [windows]]) - 1
    out = []
    for f, e, v in zip(first.tolist(), last.tolist(), least[first]):
        while f <= e:  # more than once where the same block comes again and again: each serves windows up to its start
            p = f + int((h[f : f + wide] == v).argmax())
            out.append((p, f, min(e, p)))
            f = p + 1
    return tuple(np.array(out, np.int64).T)


# Rows hold the text's key (k1, k2), the place of a block, and how far before it its windows start: far..near.
BLOCK = "k1 long, k2 long, at long, d long, w long"
SPAN = 16  # windows of one block that are judged together first


def packed(place, far, near):
    return (place << 20) | (far << 10) | near


def unpacked(at):
    return at >> 20, (at >> 10) & 1023, at & 1023


def table(schema: str, columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names=names)


def _blocks(threshold: int):
    def blocks(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode("utf-8", "replace")
                n = len(data)
                if n < threshold:
                    continue
                roll = Rolling(data)
                h = roll.blocks()
                p, first, last = anchors(h, n - threshold + 1, threshold - ANCHOR + 1)
                lo, hi = np.maximum(p - (threshold - ANCHOR), 0), np.minimum(p + threshold, n)
                # Bytes beyond the ends of a document count as different from any, by their number.
                ends = ((p - lo).astype(np.uint64) << np.uint64(32)) | (hi - p).astype(np.uint64)
                yield table(BLOCK, [*(np.full(len(p), x[k]) for x in keys), packed(p, p - first, p - last), h[p], mixed(roll.of(lo, hi) ^ ends)])

    return blocks


DIGEST = "k1 long, k2 long, first long, last long, kind long, n long, d long, w long"


def _digests(threshold: int, single: bool):
    """(text, blocks) -> digests of spans (core, and union where whole) or of single windows.

    A core is what all windows of a span hold, a union all that they hold together: a core found once settles that no
    window of the span is repeated, a union found twice that all are.
    """

    def digests(batches):
        for batch in batches:
            parts = batch.column("parts")
            flat, sizes = parts.flatten(), parts.value_lengths().to_numpy()
            at, d, n = (flat.field(c).to_numpy() for c in ("at", "d", "n"))
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            end = np.cumsum(sizes)
            for k, text in enumerate(batch.column("text").to_pylist()):
                roll = Rolling(text.encode("utf-8", "replace"))
                own = slice(end[k] - sizes[k], end[k])
                place, far, near = unpacked(at[own])
                step = 1 if single else SPAN
                count = far // step - near // step + 1
                which = np.repeat(np.arange(len(place)), count)
                s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (near // step)[which]
                b = place[which] - step * s  # the last window of the span
                a = b - step + 1
                first, last = np.maximum(a, (place - far)[which]), np.minimum(b, (place - near)[which])
                full = (first == a) & (last == b) if not single else np.zeros(len(a), bool)
                w = [mixed(roll.of(b, a + threshold) + (s.astype(np.uint64) << np.uint64(1))), mixed(roll.of(a[full], b[full] + threshold) + (s[full].astype(np.uint64) << np.uint64(1)) + np.uint64(1))]
                cols = [np.concatenate([x, x[full]]) for x in (first, last, np.zeros(len(a), np.int64), n[own][which], d[own][which])]
                cols[2][len(a) :] = 1
                yield table(DIGEST, [*(np.full(len(cols[0]), x[k]) for x in keys), *cols, np.concatenate(w)])

    return digests


KEY = ["k1", "k2"]


def _found_again(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows (a written table, which goes) whose keys have a total weight n above one. The totals are written first:
    joins of two written tables split where one key is very common."""
    totals = materialize(rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 1").select(*keys), name + "-keys")
    found = materialize(semi_join(rows, totals, keys), name)
    discard(rows, totals)
    return found


def _digested(some: DataFrame, parts: DataFrame, threshold: int, single: bool, name: str) -> DataFrame:
    listed = materialize(parts.groupBy(*KEY).agg(F.collect_set(F.struct("at", "d", "n")).alias("parts")), name + "-parts")
    made = materialize(some.join(listed, KEY).mapInArrow(_digests(threshold, single), DIGEST), name)
    discard(listed)
    return made


def repeated_windows(texts: DataFrame, threshold: int = 400) -> tuple[DataFrame, DataFrame]:
    """Rows (k1, k2, text), equal keys for equal texts -> (k1, k2, ranges), the ranges (first, last) of the starts of
    repeated windows, and the distinct texts that hold any."""
    blocks = materialize(texts.mapInArrow(_blocks(threshold), BLOCK).withColumn("n", F.lit(1)), "blocks")
    again = _found_again(blocks, ["d"], "digit1")
    alive = materialize(again.groupBy(*KEY, "at", "d", "w").agg(F.sum("n").alias("n")), "alive")  # copies become a weight
    needed = materialize(alive.select(*KEY).distinct(), "needed")
    some = bucketed(semi_join(texts, needed, KEY).groupBy(*KEY).agg(F.first("text").alias("text")), KEY, "texts")
    groups = alive.groupBy("d", "w").agg(F.sum("n").alias("n"), F.min(F.struct(*KEY, "at")).alias("one"))
    groups = materialize(groups, "digit2")
    discard(again, needed)
    twice = materialize(groups.filter("n > 1").select("d", "w"), "twice")
    far, near = F.shiftright("at", 10).bitwiseAND(F.lit(1023)), F.col("at").bitwiseAND(F.lit(1023))
    resolved = alive.join(twice, ["d", "w"], "left_semi").select(*KEY, (F.shiftright("at", 20) - far).alias("first"), (F.shiftright("at", 20) - near).alias("last"))
    resolved = materialize(resolved, "resolved")
    discard(alive, twice)
    ends = groups.groupBy("d").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).filter("least = 1 and kinds > 1").select("d")
    members = materialize(groups.join(materialize(ends, "open"), ["d"], "left_semi").select("one.*", "d", "n"), "members")
    discard(groups)
    hit = _found_again(_digested(some, members, threshold, False, "spans"), ["d", "w"], "digit3")
    whole = hit.filter("kind = 1").select(*KEY, "first", "last", "d")
    partly = hit.filter("kind = 0").join(whole, [*KEY, "first", "last", "d"], "left_anti")
    # A window of a partly repeated span may equal one of a wholly repeated span elsewhere: that one counts, too.
    unsettled = materialize(partly.select("d", "w").distinct(), "unsettled")
    again = hit.filter("kind = 0").join(unsettled, ["d", "w"], "left_semi").select(*KEY, "first", "last", "d")
    # Spans lie at multiples of SPAN before their block, whose place comes from the member they were made of.
    place = F.shiftright("at", 20).alias("place")
    at = members.select(*KEY, "d", place, (F.shiftright("at", 20) - far).alias("lo"), (F.shiftright("at", 20) - near).alias("hi"), "n")
    again = again.join(at, [*KEY, "d"]).filter("first >= lo and last <= hi")
    again = again.select(*KEY, (F.shiftleft("place", 20) + F.shiftleft(F.col("place") - F.col("first"), 10) + F.col("place") - F.col("last")).alias("at"), "d", "n")
    windows = _digested(some, again, threshold, True, "windows")
    single = _found_again(windows, ["d", "w"], "digit4").select(*KEY, "first", "last")
    discard(members, unsettled)
    ranges = resolved.unionByName(whole.drop("d")).unionByName(single)
    return materialize(ranges.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "ranges"), some


def cut(data: bytes, ranges: list[tuple[int, int]], threshold: int) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal removed byte spans, and what is left."""
    spans: list[list[int]] = []
    for first, last in sorted(ranges):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + threshold)
        else:
            spans.append([first, last + threshold])
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return [(a, b) for a, b in spans], b"".join([*kept, data[at:]])


def suffix_dedup(docs: DataFrame, threshold: int = 400, keep_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and removed_spans (and kept_text if asked for, cut characters
    at the edges of spans dropped) of each whole text in UTF-8.

    Null and empty texts have no bytes and nothing removed. Repeated rows are copies of each other. Input columns named
    like an output are replaced, all others kept; an empty table gives an empty table.
    """
    rows = without(docs, [*OUT, "_k1", "_k2", "_full", "_size"])
    t = text_of()
    rows = rows.withColumns({"_k1": F.xxhash64(t), "_k2": F.xxhash64(F.lit(1), t), "_full": F.sha2(t, 256), "_size": F.octet_length(t).cast("long")})
    texts = rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), t.alias("text"))
    ranges, some = repeated_windows(texts, threshold)
    fields = ["k1 long", "k2 long", "n_removed long", "n_spans long", "kept_sha256 string", "removed_spans array<struct<start:long,end:long>>", *["kept_text string"] * keep_text]

    def results(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8", "replace")
                spans, kept = cut(data, [(x["first"], x["last"]) for x in row["ranges"]], threshold)
                one = {"k1": row["k1"], "k2": row["k2"], "n_removed": len(data) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "removed_spans": [{"start": a, "end": b} for a, b in spans]}
                out.append(one | ({"kept_text": kept.decode("utf-8", "ignore")} if keep_text else {}))
            yield pa.RecordBatch.from_pylist(out)

    removed = materialize(some.join(ranges, KEY).mapInArrow(results, ", ".join(fields)), "removed")
    discard(some, ranges)
    known = removed.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    out = rows.join(known, ["_k1", "_k2"], "left").withColumnsRenamed({"_size": "n_bytes"})
    out = out.withColumns({"n_removed": F.coalesce("n_removed", F.lit(0).cast("long")), "n_spans": F.coalesce("n_spans", F.lit(0).cast("long")), "kept_sha256": F.coalesce("kept_sha256", "_full"), "removed_spans": F.coalesce("removed_spans", F.array())})
    return (out.withColumn("kept_text", F.coalesce("kept_text", text_of())) if keep_text else out).drop("_k1", "_k2", "_full")
