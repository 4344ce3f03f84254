"""LM scoring by cross-entropy difference.

A target model (documents labelled good) and a background model (all others, their counts scaled to the target's number
of tokens, so that both are smoothed alike) share one vocabulary: all words of the corpus, V of them (VOCABULARY if
fewer). Both are bigram models with Dirichlet smoothing towards their unigrams,
P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU), P(w) = (c(w) + 1 / 2) / (c + V / 2), with the text's start as id 0.
A document's score is the mean over its tokens of target loss less background loss, in nats: low is like the target.

Counts cover all documents and words. Words are known by 64-bit hashes. The counts of the most frequent words (fewer than
VOCABULARY) and of the bigrams of the HEAD most frequent (HEAD squared) are bounded tables, summed up per task and sent to
the tasks. All other words and bigrams go by key: documents are packed into chunks of about CHUNK tokens, a chunk sends
each of its words and bigrams once, with its counts, to the part of that key, and gets the corpus's counts back. So a
bigram that every document has comes once per chunk, and a task holds one chunk or one part, as many as the tokens need.
What travels is sorted, differenced and compressed. Tail words and their bigrams have keys of 48 and 56 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, text_of
from .hashing import mixed, slices, word_hashes

VOCABULARY = 65_535
HEAD = 512
MU = 50.0
PART = 2_000_000  # tokens a part should have
CHUNK = 1_000_000  # tokens of a chunk, or one document
TAIL = 1 << 48  # set in the ids of words beyond the most frequent, which are hashes
STEPS = 8  # bins of an octave in the histogram of word counts


def squeezed(x: np.ndarray) -> bytes:
    """Numbers below 2**64, byte by byte of equal weight, compressed."""
    x = np.ascontiguousarray(x, np.uint64)
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def opened(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel()


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The hashes of the most frequent words (fewer than VOCABULARY), by falling frequency, and the number of all words.

    The cut-off is a count, read off a histogram, so that the driver gets no more than these words.
    """

    def counted(h: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *h]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    def count(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for _, raw in slices(batch.column("text")):
                held.append(word_hashes(raw)[0])
                if sum(map(len, held)) > 4_000_000:
                    yield counted(held)
                    held = []
        yield counted(held)

    counts = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("bin", F.floor(F.log2("n") * STEPS)), "words")
    size, least, seen = 0, math.inf, 0
    for r in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):  # at most 64 * STEPS rows
        size += r["count"]
        seen += r["count"]
        if seen < VOCABULARY:
            least = r["bin"]
    known = counts.filter(F.col("bin") >= least).select("word", "n").collect() if least < math.inf else []
    discard(counts)
    return np.array([r["word"] for r in sorted(known, key=lambda r: (-r["n"], r["word"]))], np.int64).view(np.uint64), size


def _chunks(shared):
    """Texts -> chunks: the first one's key, and all their ids of documents, lengths and tokens (16 bits, VOCABULARY for
    tail words, and the tail words' own)."""

    def encoded(h: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, rank[at], h >> np.uint64(16) | np.uint64(TAIL)) if len(known) else h >> np.uint64(16) | np.uint64(TAIL)

    def chunks(batches):
        order = np.argsort(shared.value)
        known, rank = shared.value[order], (order + 1).astype(np.uint64)
        for batch in batches:
            tokens: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            start = done = 0

            def chunk():
                w, n = np.concatenate(tokens), np.concatenate(sizes)
                row = (batch.column("key")[start].as_py(), batch.column("doc_id").slice(start, len(n)).to_pylist(), squeezed(n), squeezed(np.minimum(w, VOCABULARY)), squeezed(w[w >= TAIL]))
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3))], names=["chunk", "doc_ids", "n", "ids", "tail"])

            for _, raw in slices(batch.column("text")):
                h, n = word_hashes(raw)
                tokens.append(encoded(h, known, rank))
                sizes.append(n)
                done += len(n)
                if sum(map(len, tokens)) >= CHUNK:
                    yield chunk()
                    tokens.clear()
                    sizes.clear()
                    start = done
            if sizes:
                yield chunk()

    return chunks


CHUNKS = "chunk long, doc_ids array<long>, n binary, ids binary, tail binary"


def _tokens(n: bytes, ids: bytes, tail: bytes) -> tuple[np.ndarray, ...]:
    """A chunk's lengths of documents, and for each token: its id and the id before (0 at a start)."""
    n, w = opened(n).astype(np.int64), opened(ids)
    w[w == VOCABULARY] = opened(tail)
    v = np.concatenate([np.zeros(1, np.uint64), w[:-1]]) if len(w) else w.copy()
    v[(np.cumsum(n) - n)[n > 0]] = 0
    return n, w, v


def _rows(batches):
    """Chunks with `good`, the places of the target's documents -> the chunk, its tokens, and whether each is good."""
    for batch in batches:
        for k in range(batch.num_rows):
            chunk, good, *rest = (batch.column(c)[k].as_py() for c in ("chunk", "good", "n", "ids", "tail"))
            n, w, v = _tokens(*rest)
            marked = np.zeros(len(n), np.int8)
            marked[np.array(good or [], np.int64)] = 1
            yield chunk, (n, w, v, np.repeat(marked, n))


def _tables(head_words: int):
    """Unigram (VOCABULARY: all others) and head bigram counts by class: kind 0 and 1, at, target, background."""

    def tables(batches):
        uni, head = np.zeros((2, VOCABULARY + 1), np.int64), np.zeros((2, head_words * head_words), np.int64)
        for _, (n, w, v, good) in _rows(batches):
            both = _is_head(v, w, head_words)
            for k in (0, 1):
                own = good == 1 - k
                uni[k] += np.bincount(np.minimum(w[own], VOCABULARY).astype(np.int64), minlength=VOCABULARY + 1)
                uni[k, 0] += (v[own] == 0).sum()
                own &= both
                np.add.at(head[k], (v[own] * np.uint64(head_words) + w[own]).astype(np.int64), 1)
        for kind, t in ((0, uni), (1, head)):
            at = np.flatnonzero(t.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(t[0][at]), pa.array(t[1][at])], names=["kind", "at", "t", "b"])

    return tables


class Models:
    """Both models' bounded tables: losses are computed from the counts of words and bigrams in either class."""

    def __init__(self, uni: np.ndarray, head: np.ndarray, size: int):
        self.uni, self.head = uni, head
        total = uni[:, 1:].sum(axis=1).astype(np.float64)
        self.scale = [1.0, total[0] / total[1] if total.all() else 1.0]
        self.total = [t * s + 0.5 * size for t, s in zip(total, self.scale)]

    def difference(self, v: np.ndarray, w: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Counts of the words before, of the words and of the bigrams, a row for each class."""
        p = [(c * s + MU * (y * s + 0.5) / t) / (x * s + MU) for x, y, c, s, t in zip(v, w, both, self.scale, self.total)]
        return np.log(p[1]) - np.log(p[0])


def _is_head(v: np.ndarray, w: np.ndarray, head_words: int) -> np.ndarray:
    return (v < head_words) & (w < head_words)


def _keys(v: np.ndarray, w: np.ndarray, parts: int, head_words: int) -> tuple[np.ndarray, ...]:
    """What a chunk asks for: the keys of its tail words (ids) and non-head bigrams by part, where each
    part's begin, and which tokens' words, then bigrams, they are, and the place of each among the keys.
    Bigrams of most frequent words are below 2**32, tail words between TAIL and 2 * TAIL, hashes of all other bigrams
    above; a part's keys ascend."""
    words, pairs = np.flatnonzero(w >= TAIL), np.flatnonzero(~_is_head(v, w, head_words))
    a, b = v[pairs], w[pairs]
    keys = a << np.uint64(16) | b
    odd = np.flatnonzero((a >= TAIL) | (b >= TAIL))
    keys[odd] = mixed(mixed(a[odd] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + b[odd]) >> np.uint64(8) | np.uint64(1 << 56)
    keys, which = np.unique(np.concatenate([w[words], keys]), return_inverse=True)
    part = (mixed(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], np.searchsorted(part[order], np.arange(parts + 1)), words, pairs, place[which]


def _ask(parts: int, head_words: int):
    """Chunks -> for each part: keys (each less the one before) and the chunk's counts of either class."""

    def ask(batches):
        for chunk, (n, w, v, good) in _rows(batches):
            keys, cut, words, pairs, which = _keys(v, w, parts, head_words)
            good = good[np.concatenate([words, pairs])]
            counts = [np.bincount(which, weights=good == y, minlength=len(keys)) for y in (1, 0)]
            for i in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[i], cut[i + 1])
                row = [squeezed(np.diff(keys[own], prepend=np.uint64(0))), *(squeezed(x[own]) for x in counts)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["part", "chunk", "keys", "t", "b"])

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """A part's keys summed up; each chunk gets, in the order of its keys, what other chunks have of them."""
    asked = [opened(x).cumsum(dtype=np.uint64) for x in table.column("keys").to_pylist()]
    cut = np.cumsum([0] + [len(x) for x in asked])
    keys, which = np.unique(np.concatenate(asked), return_inverse=True)
    back = []
    for c in ("t", "b"):
        own = np.concatenate([opened(x) for x in table.column(c).to_pylist()]).astype(np.int64)
        others = np.bincount(which, weights=own, minlength=len(keys)).astype(np.int64)[which] - own
        back.append(pa.array([squeezed(others[i:j]) for i, j in zip(cut, cut[1:])], pa.binary()))
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "t": back[0], "b": back[1]})


def _score(models, parts: int, head_words: int):
    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        m = models.value
        good, *rest = (chunk.column(c)[0].as_py() for c in ("good", "n", "ids", "tail"))
        n, w, v = _tokens(*rest)
        marked = np.zeros(len(n), np.int8)
        marked[np.array(good or [], np.int64)] = 1
        good = np.repeat(marked, n)
        keys, _, words, pairs, which = _keys(v, w, parts, head_words)
        answers = answers.sort_by("part")
        good = good[np.concatenate([words, pairs])]
        total = np.zeros((2, len(keys)), np.int64)
        for k, c in enumerate(("t", "b")):
            others = [opened(x) for x in answers.column(c).to_pylist()]
            total[k] = np.concatenate([np.zeros(0, np.uint64), *others]).astype(np.int64) + np.bincount(which, weights=good == 1 - k, minlength=len(keys)).astype(np.int64)
        total = total[:, which]
        of_word = m.uni[:, np.minimum(w, VOCABULARY).astype(np.int64)]
        of_word[:, words] = total[:, : len(words)]
        before = np.concatenate([of_word[:, :1], of_word[:, :-1]], axis=1)
        before[:, v == 0] = m.uni[:, :1]
        head = np.flatnonzero(_is_head(v, w, head_words))
        both = np.zeros((2, len(w)), np.int64)
        both[:, head] = m.head[:, (v[head] * np.uint64(head_words) + w[head]).astype(np.int64)]
        both[:, pairs] = total[:, len(words) :]
        loss = np.bincount(np.repeat(np.arange(len(n)), n), weights=m.difference(before, of_word, both), minlength=len(n))
        scores = pa.array(loss / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": pa.array(chunk.column("doc_ids")[0].as_py(), pa.int64()), "n_tokens": pa.array(n), "score": scores})

    return score


def cross_entropy_difference(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text: str = "text", head_words: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, score) for each row of docs; good holds the ids (doc_id) of the target's documents.

    Null and empty texts have no tokens and a null score. Repeated rows count, and are scored, each. Rows with a null id
    are background. Without target or background documents all scores are those of the untrained model. Other columns
    aren't returned; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    known, size = vocabulary(rows)
    packed = rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(_chunks(spark.sparkContext.broadcast(known)), CHUNKS)
    packed = materialize(packed, "packed")
    # Only ids travel to be marked; a chunk gets the places of its good documents.
    marked = good.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    places = packed.select("chunk", F.posexplode("doc_ids").alias("at", "doc_id")).join(marked, "doc_id", "left_semi")
    places = materialize(places.groupBy("chunk").agg(F.collect_list("at").alias("good")), "places")
    chunks = packed.join(places, "chunk", "left").select("chunk", "doc_ids", "good", "n", "ids", "tail")
    tables = chunks.mapInArrow(_tables(head_words), "kind long, at long, t long, b long").groupBy("kind", "at").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    uni, head = np.zeros((2, VOCABULARY + 1), np.int64), np.zeros((2, head_words * head_words), np.int64)
    for r in tables.collect():  # at most VOCABULARY + HEAD * HEAD rows
        (uni if r["kind"] == 0 else head)[:, r["at"]] = r["t"], r["b"]
    models = spark.sparkContext.broadcast(Models(uni, head, max(size, VOCABULARY)))
    parts = math.ceil(max(int(uni[:, 1:].sum()), 1) / PART)
    asked = chunks.mapInArrow(_ask(parts, head_words), "part int, chunk long, keys binary, t binary, b binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "chunk long, part int, t binary, b binary")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return scored.applyInArrow(_score(models, parts, head_words), "doc_id long, n_tokens long, score double")
