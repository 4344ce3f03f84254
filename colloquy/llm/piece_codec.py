"""SentencePiece encoding and decoding: exact merge-type (BPE) encoding by backtracking.

A sequence of pieces is the merge encoding of a string exactly if every piece encodes to itself and every two
neighbours encode, taken together, to just those two. So the encoder walks over the string with the longest
Aho-Corasick match at each position, keeps it if it is compatible with the piece before it (checked by re-merging
the two, memoised), and otherwise tries shorter ones or steps back. A prefix has one encoding only, so a position
that was reached and could not be continued is no piece border: a bit field remembers those positions.

Merges never cross two characters that are neighbours in no piece, so texts are cut there first, above all before spaces,
and a word's ids are remembered by the whole word, in bounded memory. Characters without a piece become their UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import without
from .hashing import Memo, slices
from .worker import owned

SPACE = "▁"
CACHED = 1 << 16  # parts of words, and pairs of pieces, that a worker remembers
WORDS = 1_500_000  # words that a worker remembers
OUT = ["n_tokens", "ids_sha256", "decoded_sha256", "piece_ids"]


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback, identity normalisation and dummy prefix."""

    def __init__(self, model: str, words: int = WORDS):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.library
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours that some merge can cross
        self.chunked = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.own = {p: (i,) for p, i in self.ids.items() if self.merge(p) == [p]}  # others never come out of merging
        self.automaton = ahocorasick.Automaton()
        for p in self.own:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.compatible = lru_cache(CACHED)(lambda a, b: self.merge(a + b) == [a, b])
        self.part = lru_cache(CACHED)(self._part)
        self.memo = Memo(self.learn, words)
        self.said = [str(i) for i in range(sp.get_piece_size())]

    def merge(self, s: str) -> list[str]:
        """Plain merging, best score and then leftmost first: the definition that encoding is checked against."""
        parts = list(s)
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], float("inf")))
            if parts[k] + parts[k + 1] not in self.rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def backtrack(self, s: str) -> list[str]:
        """The merge encoding of s, all of whose characters are pieces."""
        at: list[list[str]] = [[] for _ in s]
        for end, (n, p) in self.automaton.iter(s):
            at[end + 1 - n].append(p)  # by rising length
        out: list[str] = []
        tried = [len(at[0])]  # for each open position, how many of its matches are left
        pos, failed = 0, 0
        while pos < len(s):
            found = None
            left = tried[-1]
            while left and found is None:
                left -= 1
                p = at[pos][left]
                end = pos + len(p)
                if not failed >> end & 1 and (not out or self.compatible(out[-1], p)):
                    found = p
            tried[-1] = left
            if found is not None:
                out.append(found)
                pos = end
                tried.append(len(at[pos]) if pos < len(s) else 0)
            else:
                failed |= 1 << pos
                tried.pop()
                pos -= len(out.pop())
        return out

    def _part(self, s: str) -> tuple[int, ...]:
        if s in self.own:
            return self.own[s]
        if len(s) == 1:
            return tuple(self.byte[b] for b in s.encode("utf-8", "replace"))
        return tuple(self.ids[p] for p in self.backtrack(s))

    def _word(self, s: str) -> list[int]:
        cuts = [0, *[k for k in range(1, len(s)) if s[k - 1 : k + 1] not in self.joined], len(s)]
        return [i for a, b in zip(cuts, cuts[1:]) for i in self.part(s[a:b])]

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k in range(0, len(words), 1000):  # few Python objects at a time
            got = [self._word(w.decode("utf-8", "surrogatepass").replace(" ", SPACE)) for w in words[k : k + 1000]]
            sizes.append(np.fromiter(map(len, got), np.int32, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one more entry than texts). Words are cut before
        each run of spaces; an empty text has none."""
        raw = [(" " + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        starts = np.zeros(len(data) + 1, bool)
        if self.chunked and len(data):
            blank = data == 0x20
            starts[1:-1] = blank[1:] & ~blank[:-1]
        starts[first] = True  # of texts, and the end of all
        edges = np.flatnonzero(starts)
        ids, cut = self.memo.ids(data, edges[:-1], edges[1:])
        return ids, cut[np.searchsorted(edges, first)]

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and the same in decimal, each after a space; an empty text has none."""
        ids, _ = self.encode_all([text])
        return ids, "".join(f" {i}" for i in ids.tolist())


def codec(model: str, words: int = WORDS) -> PieceCodec:
    return owned(("pieces", model, words), lambda: PieceCodec(model, words))


def piece_digests(docs: DataFrame, model: str, eos_id: int = 2, keep_ids: bool = False, keep_text: bool = True, words: int = WORDS) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (and piece_ids if asked for) of each whole text; without the texts
    themselves, if they aren't needed. A worker remembers the ids of so many words; all texts are encoded whole, whatever it remembers.

    Null and empty texts have the end id only and decode to the empty text. Input columns of these names (in any
    case) are replaced, all others and repeated rows are kept; an empty table gives an empty table.
    """
    held = without(docs, OUT)
    names = [c for c in held.columns if keep_text or c != "text"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), *[T.ArrayType(T.IntegerType())] * keep_ids]
    schema = T.StructType([held.schema[c] for c in names] + [T.StructField(c, kind) for c, kind in zip(OUT, kinds)])

    def digest(batches):
        c = codec(model, words)
        for batch in batches:
            for at, part in slices(pc.fill_null(batch.column("text"), ""), 1024, lower=False, size=1 << 20):
                ids, cut = c.encode_all([t.decode() for t in part])
                rows = []
                for a, b in zip(cut.tolist(), cut[1:].tolist()):
                    own = [*ids[a:b].tolist(), eos_id]
                    said = " ".join(map(c.said.__getitem__, own))
                    rows.append((len(own), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(c.library.decode(own).encode()).hexdigest()))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(np.diff(cut) + 1)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.insert(ids, cut[1:], eos_id))))
                kept = [batch.column(n).slice(at, len(part)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, *OUT[: len(columns)]])

    return held.mapInArrow(digest, schema)
