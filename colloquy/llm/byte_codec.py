"""Byte-level BPE encoding and decoding, cut at forced boundaries.

A merge makes one token of the vocabulary out of two neighbours, so no merge ever crosses two bytes that stand next to
each other in no token. A table of 256 x 256 pairs tells where that is certain. Texts are cut there and the fragments
encoded independently; the ids, one fragment after the other, are those of the whole text.

It is done in two steps. Before white space, such a cut also never changes how the pattern splits what is left and right
of it: what isn't white space ends before it, and a run of white space that is cut gives the same bytes to the same side of
every certain cut. So whole batches of texts are cut into words there by numpy, and each different word is encoded once a
worker. Within a word, special tokens and then the pattern come first, as elsewhere both look across a cut (in `!'t` no
`'t` begins after the `!`, though no token holds `!'`); their parts are cut at all certain pairs, into fragments of a few
bytes. All different fragments of a batch's new words are merged together, a merge of each in every round, as rows of arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without
from .hashing import BLANK, Memo, distinct, slices
from .worker import owned

#: Fixed: the pattern of byte-level BPE, with white space by its Unicode property.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
CACHED = 1 << 16  # fragments that a worker remembers
LONG = 64  # bytes from which a fragment is merged with a heap
TOGETHER = 8192  # fragments that are merged at once
NONE = 1 << 30  # the rank of pairs that aren't merged
WIDE = 1 << 20  # above any id
SIMPLE = re.compile(rb" ?[A-Za-z]+").fullmatch  # one part under PATTERN
OUT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next free one from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteCodec:
    """Encoder and decoder of one byte-level BPE vocabulary file. `special`: whether its special tokens' strings in texts are those tokens."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        byte = letters()
        raw = lambda token: bytes(map(byte.__getitem__, token))
        ids = {raw(t): i for t, i in said["model"]["vocab"].items()}
        self.token = {i: t for t, i in ids.items()}
        self.special = {t["content"].encode(): t["id"] for t in said["added_tokens"]} if special else {}
        self.token |= {i: t for t, i in self.special.items()}
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # of two ids: rank and id of the merged token
        for rank, (a, b) in enumerate(t if isinstance(t, list) else t.split(" ") for t in said["model"]["merges"]):
            a, b = raw(a), raw(b)
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.inside = np.zeros((256, 256), bool)  # byte pairs that occur inside a token
        for t in ids:
            at = np.frombuffer(t, np.uint8)
            self.inside[at[:-1], at[1:]] = True
        self.joined = {bytes(p) for p in np.argwhere(self.inside).astype(np.uint8)}
        self.splitter = regex.compile(b"(%s)" % b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fragment = lru_cache(CACHED)(self.merge)
        self.pairs = np.array(sorted(a * WIDE + b for a, b in self.merges), np.int64)
        self.pair_rank = np.array([self.merges[divmod(p, WIDE)][0] for p in self.pairs.tolist()], np.int32)
        self.made = dict(self.merges.values())
        self.made = np.array([self.made.get(rank, -1) for rank in range(len(said["model"]["merges"]))], np.int32)
        self.of_byte = np.array(self.byte, np.int32)
        self.first = self.ranks(self.of_byte[:, None], self.of_byte[None, :])

    def merge(self, s: bytes) -> tuple[int, ...]:
        """Plain merging of a fragment, least rank and then leftmost first."""
        parts = [self.byte[b] for b in s]
        if len(parts) > LONG:
            return self._merge_long(parts)
        none = (1 << 30, 0)
        found = [self.merges.get(p, none) for p in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            parts[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = self.merges.get((parts[k - 1], parts[k]), none)
            if k < len(found):
                found[k] = self.merges.get((parts[k], parts[k + 1]), none)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same with a heap of pairs, for fragments of any length in n log n."""
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, k, parts[k], parts[k + 1]) for k in range(n - 1) if (m := self.merges.get((parts[k], parts[k + 1])))]
        heap = [(rank, k, a, b, to) for rank, to, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            other = after[k]
            if parts[k] != a or other < 0 or parts[other] != b:
                continue  # one of the two has been merged since
            parts[k], parts[other], after[k] = to, -1, after[other]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (m := self.merges.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (m[0], left, parts[left], parts[right], m[1]))
        return tuple(p for p in parts if p >= 0)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE if it isn't merged; -1 is no id."""
        pair = a.astype(np.int64) * WIDE + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], np.int32(NONE))

    def merged(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many fragments: all their ids, one after the other, and each one's number of them. A special string is its token."""
        length = np.fromiter(map(len, fragments), np.int64, len(fragments))
        start, data = np.cumsum(length) - length, np.frombuffer(b"".join(fragments) + b"\0", np.uint8)
        alone = length > LONG
        if self.special:
            alone |= np.fromiter(map(self.special.__contains__, fragments), bool, len(fragments))
        found = []
        for k in np.flatnonzero(alone).tolist():
            ids = [self.special[fragments[k]]] if fragments[k] in self.special else self._merge_long([self.byte[b] for b in fragments[k]])
            found.append((np.array([k]), np.array([len(ids)]), np.array(ids, np.int32)))
        rest = np.flatnonzero(~alone)
        rest = rest[np.argsort(length[rest], kind="stable")]  # those of like lengths make rows of like widths
        for a in range(0, len(rest), TOGETHER):
            own = rest[a : a + TOGETHER]
            found.append((own, *self._merge_rows(data, start[own], length[own])))
        size = np.zeros(len(fragments), np.int64)
        for own, sizes, _ in found:
            size[own] = sizes
        cut, flat = np.cumsum(size) - size, np.zeros(size.sum(), np.int32)
        for own, sizes, ids in found:
            flat[np.repeat(cut[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(ids))] = ids
        return flat, size

    def _merge_rows(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each fragment's number of ids, and all ids. A row a fragment, between two columns without ids; in each round, every
        row that has a pair to merge merges its one of least rank, the leftmost if several are equal."""
        wide = int(length.max()) + 2
        place = np.arange(wide - 2)
        at, inside = start[:, None] + place, place < length[:, None]
        at[~inside] = len(data) - 1
        ids, rank = np.full((len(start), wide), -1, np.int32), np.full((len(start), wide), NONE, np.int32)
        ids[:, 1:-1] = np.where(inside, self.of_byte[data[at]], -1)
        rank[:, 1:-2] = np.where(inside[:, 1:], self.first[data[at[:, :-1]], data[at[:, 1:]]], NONE)
        flat, row = ids.reshape(-1), np.arange(len(start)) * wide
        after, before = np.arange(len(flat)) + 1, np.arange(len(flat)) - 1
        while True:
            k = rank.argmin(1)
            best = rank[np.arange(len(rank)), k]
            more = best < NONE
            if not more.all():
                rank, row, k, best = rank[more], row[more], k[more], best[more]
            if not len(row):
                break
            here, each = row + k, np.arange(len(row))
            gone, left = after[here], before[here]
            right = after[gone]
            flat[here], flat[gone] = self.made[best], -1
            after[here], before[right] = right, here
            rank[each, gone - row] = NONE
            rank[each, k] = self.ranks(flat[here], flat[right])
            rank[each, left - row] = self.ranks(flat[left], flat[here])
        return (ids >= 0).sum(1), flat[flat >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, or of any texts, one after the other, and each one's number of them: word() of all at once."""
        sizes: list[int] = []  # of the pattern's parts, and of special strings
        whole: list[int] = []  # which of them are special strings
        parts = lambda s: [len(s)] if SIMPLE(s) else [len(p.encode()) for p in PATTERN.findall(s.decode())]
        for s in words:
            if self.splitter and b"<" in s:
                for part in self.splitter.split(s):
                    if part in self.special:
                        whole.append(len(sizes))
                        sizes.append(len(part))
                    else:
                        sizes += parts(part)
            else:
                sizes += parts(s)
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        edge = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        starts = np.concatenate([[True], ~self.inside[data[:-1], data[1:]], [True]])
        for k in whole:
            starts[edge[k] : edge[k + 1]] = False
        starts[edge] = True
        at = np.flatnonzero(starts)
        kinds, which = distinct(data, at[:-1], at[1:])
        flat, size = self.merged(kinds)
        begin, size = (np.cumsum(size) - size)[which], size[which]
        cut = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin - cut[:-1], size) + np.arange(cut[-1])]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        return ids, np.diff(cut[np.searchsorted(at, ends)])

    def word(self, s: bytes) -> list[int]:
        """The ids of a word, or of any text."""
        if self.splitter and b"<" in s:
            return [i for part in self.splitter.split(s) for i in ([self.special[part]] if part in self.special else self._plain(part))]
        return self._plain(s)

    def _plain(self, s: bytes) -> list[int]:
        out: list[int] = []
        for part in PATTERN.findall(s.decode()):
            p, a = part.encode(), 0
            for k in range(1, len(p)):
                if p[k - 1 : k + 1] not in self.joined:
                    out += self.fragment(p[a:k])
                    a = k
            out += self.fragment(p[a:])
        return out

    def cuts(self, data: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """Whether a word begins at each byte but the first: before white space, where the pair occurs in no token."""
        certain = BLANK[None, :] & ~(self.inside if allowed is None else self.inside | allowed)
        return certain[data[:-1], data[1:]]


def edges(data: np.ndarray, first: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where words begin, and the end of all: at the cuts, and where texts begin (`first`, and the end)."""
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = cuts
    starts[first] = True
    return np.flatnonzero(starts)


class Said:
    """Texts under a ByteCodec, by words whose ids a worker remembers."""

    def __init__(self, path: str):
        self.codec = ByteCodec(path)
        self.memo = Memo(self.codec.encode)
        tokens = [self.codec.token.get(i) for i in range(max(self.codec.token) + 1)]
        self.forms = [pa.array(x, pa.large_binary()) for x in ([b",%d" % i for i in range(len(tokens))], tokens)]

    def digests(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of what they decode to, for each text."""
        data, first = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
        at = edges(data, first, self.codec.cuts(data)) if len(data) else np.zeros(1, np.int64)
        ids, cut = self.memo.ids(data, at[:-1], at[1:])
        cut, rows = cut[np.searchsorted(at, first)], []
        for form in self.forms:  # of all texts' ids, one after the other: a comma and the decimal, the bytes
            taken = form.take(pa.array(ids))
            ends = np.frombuffer(taken.buffers()[1], np.int64)[cut].tolist()
            rows.append([memoryview(taken.buffers()[2] or b"")[a:b] for a, b in zip(ends, ends[1:])])
        hashed = lambda s: hashlib.sha256(s).hexdigest()
        return [(n, hashed(said[1:]), hashed(str(back, "utf-8", "replace").encode())) for n, said, back in zip(np.diff(cut).tolist(), *rows)]


def byte_digests(docs: DataFrame, path: str, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of each whole text; without the texts themselves, if they aren't needed.

    Null and empty texts have no ids: 0 and the digests of the empty string. Very long texts are one slice each, merged in n log n
    even where nothing cuts them. Input columns of these names (in any case) are replaced, all others and repeated rows are
    kept; an empty table gives an empty table.
    """
    held = without(docs, OUT)
    names = [c for c in held.columns if keep_text or c != "text"]
    schema = T.StructType([held.schema[c] for c in names] + [T.StructField(OUT[0], T.LongType()), *[T.StructField(c, T.StringType()) for c in OUT[1:]]])

    def digest(batches):
        said = owned(("bytes", path), lambda: Said(path))
        for batch in batches:
            for at, part in slices(pc.fill_null(batch.column("text"), ""), 1024, lower=False):
                rows = said.digests(part)
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(at, len(part)) for n in names], *columns], names=[*names, *OUT])

    return held.mapInArrow(digest, schema)
