"""The byte-level codec's merging of many fragments at once: its ids, and that new words cost less than one after the other."""

import random
import time

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from colloquy.llm import byte_codec  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def split(flat, size):
    ends = size.cumsum().tolist()
    return [flat[b - n : b].tolist() for n, b in zip(size.tolist(), ends)]


def test_texts_together_equal_the_library(monkeypatch):
    rng, tool = random.Random(5), Tokenizer.from_file(PATH)
    letters = "etaoin shrdlu''st.,0ET<|>\n\t\xa0 é中😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "<|endoftext|><|endoftext|>x"]) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "<|endoftext", "a" * 63, "a" * 64, "a" * 65, "ab" * 500, "e" * 4000, " " * 300, "x<y", "=" * 200 + "<|endoftext|>" + "=" * 64]
    wanted = [tool.encode(t, add_special_tokens=False).ids for t in texts]
    for together in (1, 7, byte_codec.TOGETHER):  # rows a batch
        monkeypatch.setattr(byte_codec, "TOGETHER", together)
        assert split(*byte_codec.ByteCodec(PATH).encode([t.encode() for t in texts])) == wanted
    tool.encode_special_tokens = True
    plain = byte_codec.ByteCodec(PATH, special=False)
    assert split(*plain.encode([t.encode() for t in texts])) == [tool.encode(t, add_special_tokens=False).ids for t in texts]
    assert split(*plain.encode([])) == [] and split(*plain.encode([b"", b""])) == [[], []]


def test_merged_rows_equal_single_merges():
    rng, codec = random.Random(6), byte_codec.ByteCodec(PATH)
    some = [bytes(rng.choice(b"etaoin shrdlu.,0ET\xc3\xa9") for _ in range(rng.randint(1, 90))) for _ in range(3000)]
    assert split(*codec.merged(some)) == [list(codec.merge(s)) for s in some]


def test_new_words_cost_less_than_one_after_the_other():
    rng = random.Random(7)
    parts = "the and ing ion ent her wh ou re on er ti an es ".split()
    words = [(" " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 6))) + rng.choice(["", ".", ",", "##"])).encode() for _ in range(30_000)]
    said, single = byte_codec.Said(PATH), byte_codec.ByteCodec(PATH)
    began = time.process_time()
    said.digests([b"".join(words)])
    together = time.process_time() - began
    for w in dict.fromkeys(words):
        single.word(w)
    assert together < 0.75 * (time.process_time() - began - together)
