"""Cross-tokenizer alignment: token groups of two vocabularies over the same bytes, and how often two ids are linked in the corpus.

Both tokenizers cover the same bytes, a space and the text. Each byte has a label: no token ends with it, one of A (a), one of B
(b), or one of both (c). A regular expression takes spans up to each c; the labels in a span count its tokens, which are one
group. Every labelled byte also ends one overlap of an A and a B token, so it is a link of these two.

Texts are cut into words where both vocabularies have a certain border (byte pairs that occur in no token of either, before white
space), so a word is tokenised and aligned once a worker, in whole batches of new words.

Counts of id pairs come from all documents: the texts are tokenised once, each document's links written in six bytes each, and added
up in tasks before they are shuffled. To give documents the counts of their links, the commonest pairs, HOT at most, are sent to
the tasks; links of all other pairs are joined. A pair beyond HOT has less than a HOT-th of all links, so no key of that join is hot.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .byte_codec import ByteCodec, edges
from .common import discard, materialize, without
from .hashing import Known, slices
from .piece_codec import SPACE, PieceCodec
from .worker import owned

HOT = 2_000_000  # pairs sent to the tasks: 34 MB
BLOCK = 8 << 20  # bytes of a row group of written links, which a task holds in memory
HELD = 1_000_000  # pairs that a task counts before it passes the counts on
WORDS = 250_000  # that a worker remembers
MARK, ODD_ENDS = SPACE.encode(), b"\xa0\n"  # B reads its mark as a space; a token of A may go on after these bytes
TIMES = (1 << 16) - 1  # the most that a written link says of how often a text has it
DOCUMENTS = 256  # whose links a task looks up at a time
SHIFT = 20  # a pair is one number: A's id, then so many bits of B's
OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SPAN = re.compile(b"[.ab]*c")
LABELS = np.frombuffer(b".abc", np.uint8)


class Aligner:
    """Words as a worker remembers them: tokens, groups, links, and the groups as they are said."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a, self.b, self.a_tool = ByteCodec(a_path, special=False), PieceCodec(b_path), Tokenizer.from_file(a_path)
        self.a_tool.encode_special_tokens = True
        self.link = link_type(a_path, b_path)
        self.a_bytes = self.a.token
        self.b_bytes = {i: p.replace(SPACE, " ").encode() for p, i in self.b.ids.items()} | {i: bytes([k]) for k, i in enumerate(self.b.byte)}
        self.lengths = [np.zeros(max(t) + 1, np.int64) for t in (self.a_bytes, self.b_bytes)]
        for n, t in zip(self.lengths, (self.a_bytes, self.b_bytes)):
            n[list(t)] = list(map(len, t.values()))
        self.within = np.zeros((256, 256), bool)  # byte pairs that B's merges can cross
        for p in self.b.joined:
            s, t = (x.replace(SPACE, " ").encode() for x in p)
            self.within[s[-1], t[0]] = True
        self.known = Known(self.learn, self.reset, WORDS)

    def reset(self) -> None:
        self.sizes = np.zeros((0, 4), np.int64)  # of each word: tokens of A, of B, groups, and 1 if its bytes don't come back
        self.left, self.right, self.start = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.said: list[str] = []

    def together(self, words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words one after the other, and each word's number of them, by A and by B: as words are cut where both have a certain
        border, many are encoded as one text, and tokens' bytes tell where words end."""
        ids, sizes = ([], []), ([], [])
        for k in range(0, len(words), 2000):
            some = [b" a", *words[k : k + 2000]]  # the first one takes what the libraries do to the front of a text
            text, end = b"".join(some).decode(), np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            for t, found in enumerate((self.a_tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.library.encode(text[1:]))):
                found = np.array(found, np.int32)
                ends = np.cumsum(self.lengths[t][found])
                at = np.searchsorted(ends, end)
                if ends[-1] != end[-1] or (ends[at] != end).any():
                    raise ValueError("a word's end is within a token")
                ids[t].append(found[at[0] + 1 :])
                sizes[t].append(np.diff(at))
        return ([np.concatenate([np.zeros(0, np.int32), *x]) for x in ids], [np.concatenate([np.zeros(0, np.int64), *x]) for x in sizes])

    def apart(self, words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The same, word by word, for those that don't go together, and which of them don't come back from a tokenizer."""
        a, b = [self.a.word(w) for w in words], [self.b._word(w.decode().replace(" ", SPACE)) for w in words]
        bad = np.array([b"".join(map(self.a_bytes.__getitem__, x)) != w or b"".join(map(self.b_bytes.__getitem__, y)) != w for x, y, w in zip(a, b, words)], bool)
        a, b = ([[] if k else x for k, x in zip(bad, own)] for own in (a, b))
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        return [np.fromiter(chain.from_iterable(x), np.int32) for x in (a, b)], sizes, bad

    def learn(self, words: list[bytes]) -> None:
        odd = np.fromiter((w[-1] in ODD_ENDS or MARK in w for w in words), bool, len(words))
        order = np.argsort(odd, kind="stable")
        plain, rest = [w for w, o in zip(words, odd) if not o], [w for w, o in zip(words, odd) if o]
        ids, n = self.together(plain)
        more, m, wrong = self.apart(rest)
        ids, n = [np.concatenate(x) for x in zip(ids, more)], [np.concatenate(x) for x in zip(n, m)]
        bad = np.concatenate([np.zeros(len(plain), bool), wrong])
        if rest:  # back to the order of the words
            back = np.argsort(order)
            first = [np.cumsum(x) - x for x in n]
            ids = [x[np.concatenate([np.zeros(0, np.int64), *[np.arange(f[k], f[k] + c[k]) for k in back.tolist()]])] for x, f, c in zip(ids, first, n)]
            n, bad = [x[back] for x in n], bad[back]
        end = [np.cumsum(lengths[x]) for lengths, x in zip(self.lengths, ids)]
        label = np.zeros(int(end[0][-1]) if len(end[0]) else 0, np.uint8)
        label[end[0] - 1] += 1
        label[end[1] - 1] += 2
        said, groups = self._groups(LABELS[label].tobytes(), *ids)
        at = np.flatnonzero(label)
        left = ids[0][np.cumsum(label[at] & 1) - (label[at] & 1)]
        right = ids[1][np.cumsum(label[at] >> 1) - (label[at] >> 1)]
        first = np.concatenate([[0], np.cumsum(n[0])])  # words' tokens of A; a group lies within a word
        cut = np.searchsorted(groups, first).tolist()
        count = np.diff(cut)
        self.said += [";".join(said[x:y]) for x, y in zip(cut, cut[1:])]
        self.sizes = np.concatenate([self.sizes, np.column_stack([*n, count, bad])])
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n[0] + n[1] - count)])

    def _groups(self, labels: bytes, a: np.ndarray, b: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Each group as `a1,a2|b1`, and the number of its first token of A."""
        spans = SPAN.findall(labels)
        x, y = (np.concatenate([[0], np.cumsum(np.fromiter((s.count(k) + 1 for s in spans), np.int64, len(spans)))]) for k in (b"a", b"b"))
        a, b, p, q = list(map(str, a.tolist())), list(map(str, b.tolist())), x.tolist(), y.tolist()
        said = [a[i] + "|" + b[k] if j == i + 1 and m == k + 1 else ",".join(a[i:j]) + "|" + ",".join(b[k:m]) for i, j, k, m in zip(p, p[1:], q, q[1:])]
        return said, x[:-1]

    def align(self, texts: list[bytes]) -> dict[str, pa.Array]:
        """Columns of the texts: sizes, digest, and the links of each different word, with how often the word occurs."""
        raw = [b" " + t if t else b"" for t in texts]
        data, first = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, raw)))])
        at = edges(data, first, self.a.cuts(data, self.within)) if len(data) else np.zeros(1, np.int64)
        words, begin = self.known.of(data, at[:-1], at[1:]), np.searchsorted(at, first)
        totals = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[words], axis=0)])[begin], axis=0)
        good = totals[:, 3] == 0
        totals[~good] = 0
        own = words.tolist()
        digests = [hashlib.sha256(";".join(map(self.said.__getitem__, own[x:y])).encode()).hexdigest() if ok and y > x else "" for x, y, ok in zip(begin.tolist(), begin[1:].tolist(), good.tolist())]
        text = np.repeat(np.arange(len(texts)), np.diff(begin))
        both, often = np.unique((text * np.int64(max(1, len(self.said))) + words)[good[text]], return_counts=True)
        text, word = np.divmod(both, max(1, len(self.said)))
        rows = -(-often // TIMES)  # a word that a text says more often than fits has several
        last = np.cumsum(rows) - 1
        text, word, times = np.repeat(text, rows), np.repeat(word, rows), np.full(int(rows.sum()), TIMES)
        times[last] = often - (rows - 1) * TIMES
        size = self.start[word + 1] - self.start[word]
        cut = np.concatenate([[0], np.cumsum(size)])
        links = np.repeat(self.start[word] - cut[:-1], size) + np.arange(cut[-1])
        packed = np.empty(len(links), self.link)
        packed["left"], packed["right"], packed["times"] = self.left[links], self.right[links], np.repeat(times, size)
        ends = (cut[np.searchsorted(text, np.arange(len(texts) + 1))] * self.link.itemsize).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(packed.tobytes())])
        n_a, n_b, n_groups = (totals[:, k] for k in range(3))
        return {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_a + n_b - n_groups), "groups_sha256": pa.array(digests), "links": column}


def link_type(a_path: str, b_path: str) -> np.dtype:
    """A link as it is written: two ids, of two bytes each where both vocabularies allow it, and how often the text has it."""
    sizes = Tokenizer.from_file(a_path).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    kind = "<u2" if max(sizes) <= 1 << 16 else "<u4"
    return np.dtype([("left", kind), ("right", kind), ("times", "<u2")])


def _pairs(batch: pa.RecordBatch, link: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair and times of all links of a batch of documents, and where each document's end."""
    column = batch.column("links")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    links = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(link) if data is not None else np.zeros(0, link)
    return links["left"].astype(np.int64) << SHIFT | links["right"], links["times"], (ends[1:] - ends[0]) // link.itemsize


def parts_of(batches):
    """Arrow's batches, some documents at a time: Spark bounds them by rows only."""
    for batch in batches:
        for k in range(0, len(batch), DOCUMENTS):
            yield batch.slice(k, DOCUMENTS)


def _added(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, which = np.unique(pair, return_inverse=True)
    return kinds, np.bincount(which, weights=n, minlength=len(kinds)).astype(np.int64)


def pair_counts(aligned: DataFrame, link: np.dtype) -> DataFrame:
    """(pair, n, best): the links of each id pair in all documents, and whether no other pair of its B id has more."""

    def count(batches):
        pair, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def rows():
            for k in range(0, len(pair[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[0][k : k + 50_000]), pa.array(n[0][k : k + 50_000])], names=["pair", "n"])
            pair[:], n[:] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        owned("pairs", dict)  # what the worker remembers of words goes
        for batch in parts_of(batches):
            found, times, _ = _pairs(batch, link)
            found, times = _added(found, times)
            pair.append(found)
            n.append(times)
            if sum(map(len, pair)) > 2 * HELD:
                pair[:], n[:] = ([x] for x in _added(np.concatenate(pair), np.concatenate(n)))
                if len(pair[0]) > HELD:
                    yield from rows()
        pair[:], n[:] = ([x] for x in _added(np.concatenate(pair), np.concatenate(n)))
        yield from rows()

    sums = materialize(aligned.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    most = sums.groupBy(b_id).agg(F.max("n").alias("most"))
    return sums.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot(counts: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """The pairs of the largest counts, `hot` at most, and whether there are others; counts within a sixteenth of an octave go together."""
    step = F.floor(F.log2("n") * 16).alias("step")
    steps = counts.groupBy(step).count().orderBy(F.desc("step")).collect()  # a few hundred rows
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > hot:
            least = r["step"]
            break
    return (counts if least is None else counts.filter(F.floor(F.log2("n") * 16) > least)), least is not None


def align(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT) -> DataFrame:
    """docs without the text, with each text's tokens of A and B, groups, links, links that are their B id's commonest, sum of
    its links' corpus counts, and the groups' digest.

    Null and empty texts, and those whose bytes a tokenizer doesn't give back, have no tokens: zeros and ''. Input columns of
    these names (in any case) are replaced, others and repeated rows kept, which count as often as they occur; an empty table gives an
    empty table. Ties of a B id's commonest pairs all count.
    """
    held = without(docs, OUT)
    names = [c for c in held.columns if c != "text"]
    own = [f"c{k}" for k in range(len(names))]  # whatever the input calls its columns, none clashes with ours
    link = link_type(a_path, b_path)
    long, ints = T.LongType(), T.ArrayType(T.IntegerType())
    kinds = {"n_a": long, "n_b": long, "n_groups": long, "n_links": long, "groups_sha256": T.StringType(), "links": T.BinaryType()}
    kept = [T.StructField(o, held.schema[c].dataType) for o, c in zip(own, names)]

    def tokens(batches):
        aligner = owned(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            for at, texts in slices(pc.fill_null(batch.column("text"), ""), 1024, lower=False):
                found = aligner.align(texts)
                yield pa.RecordBatch.from_arrays([*[batch.column(o).slice(at, len(texts)) for o in own], *[found[c] for c in kinds]], names=[*own, *kinds])

    renamed = held.select(*[F.col(f"`{c}`").alias(o) for o, c in zip(own, names)], "text")
    aligned = materialize(renamed.mapInArrow(tokens, T.StructType([*kept, *[T.StructField(c, k) for c, k in kinds.items()]])), "aligned", BLOCK)
    counts = materialize(pair_counts(aligned, link), "pair-counts")
    common, more = _hot(counts, hot)
    table = common.toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    shared = docs.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order]))
    plain = [c for c in kinds if c != "links"]
    out = [*own, *plain]

    def counted(batches):
        owned("pairs", dict)
        pair, n, best = shared.value
        for batch in parts_of(batches):
            found, times, end = _pairs(batch, link)
            at = np.minimum(np.searchsorted(pair, found), max(0, len(pair) - 1))
            hit = pair[at] == found if len(pair) else np.zeros(len(found), bool)
            often, top = np.where(hit, n[at], 0) if len(pair) else np.zeros(len(found), np.int64), np.where(hit, best[at], False) if len(pair) else np.zeros(len(found), bool)
            end = np.concatenate([[0], end])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x * times.astype(np.int64))])[end]) for x in (top, often)]
            rare = np.concatenate([[0], np.cumsum(~hit)])[end].astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rare), pa.array(x[~hit])) for x in (found, times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], *map(pa.array, sums), *left], names=[*out, "n_best", "count_sum", "pair", "times"])

    schema = T.StructType([*kept, *[T.StructField(c, kinds[c]) for c in plain], T.StructField("n_best", long), T.StructField("count_sum", long), T.StructField("pair", T.ArrayType(long)), T.StructField("times", ints)])
    rows = aligned.mapInArrow(counted, schema)
    if more:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "counted")
        rare = rows.filter(F.size("pair") > 0).select("row", F.explode(F.arrays_zip("pair", "times")).alias("l")).select("row", F.col("l.pair").alias("pair"), F.col("l.times").cast("long").alias("times"))
        sums = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        rows = rows.join(sums, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return rows.select(*[F.col(o).alias(c) for o, c in zip(own, names)], *OUT)
