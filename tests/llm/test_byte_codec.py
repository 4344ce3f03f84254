"""The byte-level codec against the library, on odd, random and whole texts; forced cuts against the vocabulary."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from colloquy.llm import byte_codec, queries  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcdeeth in  .,\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'\"-_!?<|>sdtmlrv0123ABC\x00́éßü中😀²½"
ODD = ["", None, "   ", "\n\n\t", "\xa0 \xa0 x", "a<|endoftext|>b <|endoftext|><|endoftext|>  <|endof", "!'t don't", "a" * 5000, " " * 3000, "ab" * 40_000, "x " * 40_000, "é中😀\x00 b"]


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def said():
    return byte_codec.Said(PATH)


def wanted(tool, text):
    ids = tool.encode(text or "", add_special_tokens=False).ids
    back = tool.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_random_strings_equal_the_library(tool, said):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) + rng.choice(["", "", "<|endoftext|>x"]) for _ in range(6000)]
    assert said.digests([t.encode() for t in texts]) == [wanted(tool, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=30))
def test_any_string_equals_the_library(tool, said, text):
    assert said.codec.word(text.encode()) == tool.encode(text, add_special_tokens=False).ids


def test_special_strings_can_be_plain_text(tool):
    tool = Tokenizer.from_file(PATH)
    tool.encode_special_tokens = True
    text = "a<|endoftext|>b <|endoftext|>"
    assert byte_codec.ByteCodec(PATH, special=False).word(text.encode()) == tool.encode(text, add_special_tokens=False).ids


def test_no_token_holds_a_certain_pair_and_fragments_join(said):
    codec, rng = said.codec, random.Random(9)
    assert not any(not codec.inside[a, b] for t in codec.token.values() if t not in codec.special for a, b in zip(t, t[1:]))
    for _ in range(300):  # merged whole, a string gives what its fragments give
        s = bytes(rng.choice(b"etaoin shrdlu.,0ET") for _ in range(rng.randint(1, 150)))
        cuts = [0, *[k for k in range(1, len(s)) if s[k - 1 : k + 1] not in codec.joined], len(s)]
        assert codec.merge(s) == tuple(i for a, b in zip(cuts, cuts[1:]) for i in codec.merge(s[a:b]))
        assert codec._merge_long([codec.byte[b] for b in s]) == codec.merge(s) or len(s) > byte_codec.LONG


def test_rows_equal_the_library(spark, small, tool):
    schema = "doc_id long, text string, N_TOKENS string, other string"
    rows = [(i, t, "clash", "kept") for i, t in enumerate(ODD)]
    odd = spark.createDataFrame([*rows, rows[5], (None, "null id", None, None)], schema)
    got = byte_codec.byte_digests(odd, PATH).collect()
    assert len(got) == len(ODD) + 2 and set(got[0].asDict()) == {"doc_id", "text", "other", *byte_codec.OUT}
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(tool, r.text)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op12_byte_codec(spark, small).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == wanted(tool, texts.pop(r.doc_id))
    assert not texts
    assert byte_codec.byte_digests(odd.limit(0), PATH).count() == 0
