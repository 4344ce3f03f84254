"""Cross-tokenizer alignment against both libraries: groups by offsets, links by overlapping ranges, counts over all rows."""

import hashlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from colloquy.llm import byte_codec, queries, token_alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "   ", "\n\n\t", "é中😀\x00 b", "a▁b is not given back", "ab́ ΑΣ İx <|endoftext|> don't <s> <0x41>", "x " * 3000, "a" * 5000, "one two\nthree  four\t\tfive", "!'t \xa0 nbsp", "tokenisation, tokenization", "so " * 70_000]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def ranges(tokens):
    end, out = 0, []
    for i, t in tokens:
        out.append((end, end + len(t), i))
        end += len(t)
    return out


def plain(tools, text):
    """Groups and links of a text, or None."""
    a, b = tools
    byte = byte_codec.letters()
    if not text:
        return None
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ib = b.encode(text)
    ta = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ia]
    tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ib]
    raw = (" " + text).encode()
    if any(b"".join(t for _, t in x) != raw for x in (ta, tb)):
        return None
    ra, rb = ranges(ta), ranges(tb)
    common = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
    groups, links, start, j = [], [], 0, 0
    for end in common:
        groups.append(([i for s, e, i in ra if start <= s < end], [i for s, e, i in rb if start <= s < end]) if len(raw) < 2000 else None)
        start = end
    for s, e, i in ra:  # both ascend
        while j and rb[j - 1][1] > s:
            j -= 1
        while j < len(rb) and rb[j][0] < e:
            if rb[j][1] > s:
                links.append((i, rb[j][2]))
            j += 1
    if len(raw) >= 2000:
        x, groups = 0, []
        y = 0
        for end in common:
            p, q = x, y
            while p < len(ra) and ra[p][1] <= end:
                p += 1
            while q < len(rb) and rb[q][1] <= end:
                q += 1
            groups.append(([t[2] for t in ra[x:p]], [t[2] for t in rb[y:q]]))
            x, y = p, q
    return len(ia), len(ib), groups, links


def wanted(tools, texts):
    found = [plain(tools, t) for t in texts]
    n = Counter(link for f in found if f for link in f[3])
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        out.append((f[0], f[1], len(f[2]), len(f[3]), sum(n[x] == most[x[1]] for x in f[3]), sum(n[x] for x in f[3]), hashlib.sha256(said.encode()).hexdigest()))
    return out


COLUMNS = token_alignment.OUT


def test_odd_texts_with_and_without_rare_pairs(spark, tools):
    texts = [*ODD, ODD[9], "null id"]
    rows = [(i, t, "clash", "kept") for i, t in enumerate(texts[:-2])] + [(9, ODD[9], "clash", "kept"), (None, "null id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, LEFT string, n_links string")
    want = Counter(zip([r[0] for r in rows], wanted(tools, texts)))
    assert sum(len(t or "") for t in texts) > 200_000  # a word more often than a written link can say
    for hot in (token_alignment.HOT, 50, 0):
        got = token_alignment.align(df, A, B, hot)
        assert set(got.columns) == {"doc_id", "LEFT", *COLUMNS}
        assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in got.collect()) == want
    assert token_alignment.align(df.limit(0), A, B).count() == 0
    assert [r.n_a for r in token_alignment.align(df.filter("doc_id < 2"), A, B).collect()] == [0, 0]


def test_query_equals_libraries(spark, small, tools):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], wanted(tools, [r.text for r in docs])))
    got = queries.op11_token_alignment(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id]


def test_labels_make_groups_and_links():
    aligner = token_alignment.Aligner(A, B)
    said, first = aligner._groups(b"..c.ab.c", *map(__import__("numpy").array, ([1, 2, 3], [4, 5, 6])))
    assert said == ["1|4", "2,3|5,6"] and first.tolist() == [0, 1]
    aligner.learn([b" tokenisation", b" the", "a▁b".encode()])
    n_a, n_b, groups, bad = aligner.sizes.T.tolist()
    assert bad == [0, 0, 1] and [n_a[2], n_b[2], groups[2]] == [0, 0, 0]
    assert [x + y - g for x, y, g in zip(n_a, n_b, groups)] == (aligner.start[1:] - aligner.start[:-1]).tolist()
