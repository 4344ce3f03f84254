"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and the form each belongs to.

A word of L letters is cut into two segments of even length. If another word, of L or L + 1 letters, is one edit away, the
edit lies in one segment, so the other one occurs in that word too: the first at the same place, the second at the same place
or, in a word that is one longer, one place on. Words are indexed by their segments and probe with those of their own length
and of the length below; candidates of a shared segment, each once, are verified by their edit distance.

A segment that many words share is cut finer instead of giving all pairs of them. In these words the edit lies in the rest,
which is cut evenly in its turn: one half of it must match as well. So a key is what matches at the front and at the back
around a gap that halves until the words of a key are few, so the candidates stay in proportion to the words. A gap of one letter
is left as it is: no more words than letters (90), and pairs of letters, fit into it.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .hashing import distinct, slices

LEAST, TWICE = 7, 2  # code points of a word, and occurrences
FORM = 10  # times the occurrences that a word's form has at least
FEW = 16  # words of a key that are compared in pairs
HELD = 400_000  # words that a task counts before it passes the counts on
DROP = 31  # one in so many (document, run) pairs loses a code point


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which A-Z are a-z, where each run of letters (A-Z, a-z, U+00C0 to U+00FF) begins and ends, and its text's number.

    In UTF-8 the latter letters are the byte 0xC3 and one more; texts are parted by a line feed.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    data[upper] += 32
    letter = (data >= 0x61) & (data <= 0x7A) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3
    turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    turn = np.concatenate([[0], turn]) if letter[0] else turn
    start, end = turn[::2], turn[1::2]
    last = np.cumsum([len(t) + 1 for t in texts])
    return data, start, end, np.searchsorted(last, start, side="right")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of LEAST code points or more occurs, in all whole texts.

    Of a (doc_id, run) whose crc32 is divisible by DROP, the run loses one code point. Null texts have no runs; a null doc_id reads
    as the empty string. Repeated rows count as often as they occur.
    """

    def count(batches):
        found: dict[bytes, int] = defaultdict(int)

        def rows():
            some = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            for k in range(0, len(some), 10_000):
                yield some.slice(k, 10_000)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, texts in slices(pc.fill_null(batch.column("text"), ""), 4096, lower=False, size=4 << 20):
                data, start, end, text = runs(texts)
                kinds, which = distinct(data, start, end)
                both, often = np.unique(text * np.int64(max(1, len(kinds))) + which, return_counts=True)
                own, kind = both // max(1, len(kinds)), both % max(1, len(kinds))
                first = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[at : at + len(texts)]]
                h = np.fromiter((zlib.crc32(kinds[k], first[d]) for d, k in zip(own.tolist(), kind.tolist())), np.int64, len(both))
                cut = h % DROP == 0
                total = np.bincount(kind[~cut], weights=often[~cut], minlength=len(kinds)).astype(np.int64)
                for w, n in zip(kinds, total.tolist()):
                    if n and len(w) >= LEAST and len(w) - w.count(0xC3) >= LEAST:
                        found[w] += n
                for k, n, x in zip(kind[cut].tolist(), often[cut].tolist(), h[cut].tolist()):
                    w = kinds[k].decode()
                    if len(w) > LEAST:
                        p = x % len(w)
                        found[(w[:p] + w[p + 1 :]).encode()] += n
                if len(found) > HELD:
                    yield from rows()
        yield from rows()

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of each row's front and back around its gap, for words of a base length: 128 bits of a digest."""
    front, back = F.expr("substring(word, 1, front)"), F.expr("substring(word, char_length(word) - back + 1, back)")
    key = F.struct(*[F.xxhash64(F.lit(s), "base", "front", front, back) for s in (1, 2)])
    return rows.withColumn("key", key)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: its gap halved from the front, and from the back."""
    gap = F.col("base") - F.col("front") - F.col("back")
    half: Column = F.floor(gap / 2).cast("int")
    ends = F.array(F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back")), F.struct(F.col("front").alias("front"), (F.col("back") + gap - half).alias("back")))
    return rows.select("word", "base", F.explode(ends).alias("e")).select("word", "base", "e.front", "e.back")


def near_words(words: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b): all pairs of the column word that are one inserted, deleted or replaced code point apart, each pair once.

    Words are distinct and not null. Every word of L letters probes as one of L and, as the longer of a pair, of L - 1.
    """
    size = F.char_length("word")
    rows = words.select("word", F.explode(F.array(size, size - 1)).alias("base")).filter("base >= 1")
    rows = _halved(rows.withColumns({"front": F.lit(0), "back": F.lit(0)}))
    found, old = [], None
    while True:
        rows = materialize(_keyed(rows), "segments")
        if old:
            discard(old)
        crowd = rows.groupBy("key").agg(F.count("*").alias("words"), F.max(F.col("base") - F.col("front") - F.col("back")).alias("gap")).filter((F.col("words") > few) & (F.col("gap") > 1)).select("key")
        crowd = materialize(crowd, "crowded")
        small = rows.join(crowd, "key", "left_anti")
        longer = F.char_length("word") > F.col("base")
        index = small.filter(~longer).select("key", F.col("word").alias("a"))
        probe = small.select("key", F.col("word").alias("b"), longer.alias("longer"))
        pairs = index.join(probe, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(materialize(pairs.select("a", "b"), "pairs"))
        old, rows = rows, _halved(rows.join(crowd, "key", "left_semi"))
        if crowd.isEmpty():
            discard(old, crowd)
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def variants(docs: DataFrame) -> DataFrame:
    """Each word of the texts with its number n, how many words are near it, its form, the form's n and the root of its forms.

    A word has LEAST code points and occurs TWICE at least. Its form is the near word of largest n (ties: the first in code-point
    order) if that is FORM times its own; following forms, n grows tenfold each time, so a root is few steps away. Null,
    empty and short texts give no words, an empty table no rows, however many columns there are.
    """
    words = materialize(word_counts(docs).filter(F.col("n") >= TWICE), "words")
    pairs = materialize(near_words(words.select("word")), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("b").alias("w"))).alias("best")  # strings compare by code points in UTF-8
    near = other.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    far = -F.col("best.m") >= FORM * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.w")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    rows = materialize(rows, "forms")
    jumps = materialize(rows.filter("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:  # pointers double: a chain of 16 forms takes four rounds
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if jumps.join(onward, "root", "left_semi").isEmpty():
            break
        old = jumps
        jumps = materialize(jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "jumps")
        discard(old)
    return rows.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
