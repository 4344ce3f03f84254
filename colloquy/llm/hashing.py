"""Words and slices of whole batches of bytes: their 64-bit hashes, and exact memories of them."""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ROWS, BYTES = 256, 1 << 20  # texts that a task holds as Python objects: so many, or so many bytes, or one
LONG = 4 * BYTES
BASE = 0x9E3779B97F4A7C15
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


@cache
def numbers() -> np.ndarray:
    """A 64-bit number for each byte, fixed by a digest."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse (modulo 2**64), from 0 to size."""
    up, down = np.ones(size + 1, np.uint64), np.ones(size + 1, np.uint64)
    up[1:] = np.cumprod(np.full(size, BASE, np.uint64))
    down[1:] = np.cumprod(np.full(size, pow(BASE, -1, 1 << 64), np.uint64))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each word (cut at ASCII white space) begins and ends in them, and each text's number of words."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = edges if blank[0] else np.concatenate([[0], edges])
    start, end = edges[::2], edges[1::2]
    last = np.cumsum([len(t) + 1 for t in texts])
    return data, start, end, np.diff(np.searchsorted(start, last), prepend=0)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different slices, as bytes, and which of them each slice is: exact, by Arrow's dictionary. Slices ascend and don't overlap."""
    if not len(start):
        return [], np.zeros(0, np.int64)
    edges = np.empty(2 * len(start), np.int64)  # slices, and the gaps between them
    edges[::2], edges[1::2] = start, end
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = every.dictionary_encode()
    which, kinds = coded.indices.to_numpy()[::2], coded.dictionary
    used = np.zeros(len(kinds), bool)
    used[which] = True
    cut, raw = np.frombuffer(kinds.buffers()[1], np.int64)[: len(kinds) + 1], kinds.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(cut[:-1][used].tolist(), cut[1:][used].tolist())], (np.cumsum(used) - 1)[which]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit XXH3 hash of each slice; slices ascend and don't overlap. Each different slice is hashed once."""
    kinds, which = distinct(data, start, end)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))[which]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, in order, and each text's number of words. Of more than LONG bytes, which would take
    many times as much memory as single words, only different words become objects; both ways give the same."""
    if sum(map(len, texts)) > LONG:
        data, start, end, count = words_of(texts)
        return hashes(data, start, end), count
    words = [t.split() for t in texts]
    count = np.array([len(x) for x in words], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(count.sum())), count


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text (all its words, if it has fewer), ascending, one text after the other; how often
    each occurs in its text; and where each text's begin (one more entry than texts)."""
    h, count = word_hashes(texts)
    size = np.where(count, np.maximum(count - words + 1, 1), 0)
    first, cut = np.cumsum(count) - count, np.concatenate([[0], np.cumsum(size)])
    at = np.arange(cut[-1]) - np.repeat(cut[:-1] - first, size)
    width = np.repeat(np.minimum(count, words), size)
    s = np.zeros(len(at), np.uint64)
    for k in range(words):
        more = slice(None) if (width > k).all() else width > k
        s[more] = s[more] * np.uint64(BASE) + h[at[more] + k]
    s = mixed(s + width.astype(np.uint64))
    for a, b in zip(cut.tolist(), cut[1:].tolist()):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[cut[:-1][size > 0]] = True
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(at, cut)


def slices(column: pa.Array, rows: int = ROWS, lower: bool = True, size: int = BYTES):
    """(first row, bytes of some texts): the texts of an Arrow column, a bounded number at a time, in lower case if asked for."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0)
    a = 0
    while a < len(column):
        before = ends[a - 1] if a else 0
        b = min(max(a + 1, int(np.searchsorted(ends, before + size, side="right"))), a + rows, len(column))
        some = column.slice(a, b - a)
        yield a, [t.lower().encode("utf-8", "surrogatepass") for t in some.to_pylist()] if lower else some.cast(pa.binary()).to_pylist()
        a = b


class Known:
    """Numbers of words, exact: a worker's words are keys of a dictionary, new ones are given to learn() in the order of their numbers.

    All are forgotten (and reset() is called) before a call that would hold more than `most` words, or once they have more than
    `size` bytes, so a worker needs bounded memory however many words there are, and however long.
    """

    def __init__(self, learn, reset, most: int = 500_000, size: int = 32 << 20):
        self.learn, self.reset, self.most, self.size = learn, reset, most, size
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.reset()

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each slice; slices ascend and don't overlap. Numbers hold until the next call."""
        kinds, which = distinct(data, start, end)
        at = np.fromiter(map(self.number.get, kinds, repeat(-1)), np.int64, len(kinds))
        fresh = np.flatnonzero(at < 0)
        if self.bytes > self.size or len(self.number) + len(fresh) > self.most:
            self.forget()
            fresh = np.arange(len(kinds))
        if len(fresh):
            new = [kinds[k] for k in fresh.tolist()]
            self.learn(new)
            at[fresh] = range(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, at[fresh].tolist()))
            self.bytes += sum(map(len, new))
        return at[which]


class Memo:
    """Ids of words, learned once a worker: learn() takes words and gives all their ids and each one's number of them.

    Words are compared whole (Known); where each word's ids begin in `flat` and how many they are is kept by its number.
    """

    def __init__(self, learn, most: int = 1_500_000):
        self.ids_of = learn
        self.known = Known(self.learn, self.reset, most)

    def reset(self) -> None:
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[bytes]) -> None:
        flat, size = self.ids_of(words)
        size = np.asarray(size, np.int32)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size, dtype=np.int64) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, np.asarray(flat, np.int32)])

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slices, one after the other, and where each one's begin (one more entry than slices)."""
        at = self.known.of(data, start, end)
        size = self.size[at]
        cut = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.flat[np.repeat(self.start[at] - cut[:-1], size) + np.arange(cut[-1])], cut
