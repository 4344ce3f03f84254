"""Cases of the third round's findings, held against the queries' own SQL."""

import re

import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import blocks, knowledge, ordered
from colloquy.plans.catalog import oracle_sql, queries
from colloquy.streaming import live

from .test_catalog import canon


def same_as_sql(spark, folder, name, **tables):
    """The query's rows over small tables of its own, which must be those of its SQL."""
    c = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = queries()[name](spark, str(folder)).toPandas()
    assert canon(got) == canon(c.execute(oracle_sql()[name]).df())
    return got


def test_mixed_samples_are_scaled_in_single_precision(spark, tmp_path):
    """-0.196 as a float is a little nearer to zero: times 1000 it is -196 in single and -195.99999 in double precision."""
    rows = [(k, [x] * 64) for k, x in enumerate((-0.196, 0.053, -0.159, 0.5, -0.0005))]
    same_as_sql(spark, tmp_path, "mixed_samples", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def test_aligned_units_stay_out_of_the_driver(spark, small, tmp_path):
    """Units are many more than the bytes of a packed table tell, so no join may send them to all tasks; a long meeting lies on many ranges."""
    plan = queries()["aligned_sentences"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[[^\]]*_at#", plan)
    rows = [(k % 50 and 1, k, "u", "one two, three " * (k % 4) if k % 7 else None) for k in range(3000)]
    same_as_sql(spark, tmp_path, "aligned_sentences", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").filter("text is not null"))


def test_running_sums_of_null_and_long_keys(spark):
    rows = [(None if k % 3 == 0 else "a" if k % 3 == 1 else f"k{k}", k, k % 5) for k in range(2000)]
    df = spark.createDataFrame(rows, "k string, o long, n long").repartition(3)
    want, held = [], {}
    for k, o, n in rows:
        want.append((o, held.get(k, 0)))
        held[k] = held.get(k, 0) + n
    assert sorted((r.o, r.s) for r in blocks.running(df, ["k"], ["o"], F.col("n"), "s").collect()) == want
    assert blocks.running(df.limit(0), ["k"], ["o"], F.col("n"), "s").count() == 0


def test_voiced_windows_over_many_pieces(spark, tmp_path):
    """Recordings of several pieces, of just one window and of none, null values and keys: windows are found in pieces, not in whole recordings."""
    kinds = ["a"] * 40 + ["b", None]
    rows = [(k, kinds[k % 42], k % 2 * 10, None if k % 97 == 0 else (k * 7919 % 1000) / 10) for k in range(12_000)]
    rows += [(20_150 + k, "c", 3, 7.0) for k in range(12)] + [(30_150 + k, "d", 3, 7.0) for k in range(11)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double")
    got = same_as_sql(spark, tmp_path, "voiced_windows", events=events)
    assert set(got["event_type"]) == {"a", "b", "c", None} and (got["event_type"] == "c").sum() == 1
    assert got["window_start"].max() > ordered.PIECE / 4
    sound = [(1, k, float(k % 17)) for k in range(9000)]
    some = ordered.voiced_windows(spark.createDataFrame(sound, "r long, k long, x double"), ["r"], "k", F.col("x"), 5, 2.5, 0.5)  # hops of 2.5 samples
    want = {k * 0.5: (sum((int(k * 2.5) + i) % 17 * ((int(k * 2.5) + i) % 17) for i in range(12)) / 12) ** 0.5 for k in range(int((9000 / 5 - 2.5) / 0.5) + 1)}
    assert {r.window_start: round(r.rms, 9) for r in some.collect()} == {k: round(v, 9) for k, v in want.items()}
    plan = queries()["voiced_windows"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "_piece" in plan  # samples are gathered by piece


def test_grouped_by_type_lists_all_users(spark, tmp_path):
    rows = [(k % 3 and f"t{k % 3}", k * 31 % 700 if k % 11 else None) for k in range(4000)] + [("nobody", None)]
    got = same_as_sql(spark, tmp_path, "grouped_by_type", events=spark.createDataFrame([(a or None, b) for a, b in rows], "event_type string, user_id long"))
    assert list(got.columns) == ["event_type", "users"]


def test_texts_are_chunked_some_at_a_time(spark):
    """Workers hold a bounded number of bytes of texts, or one text; chunks are those of chunk_text(), of null, blank and long texts too."""
    sizes = [0, 10, knowledge.BYTES, 5, knowledge.BYTES * 2, *[1000] * 3000]
    cut = list(knowledge._slices(pa.array([None, *["x" * n for n in sizes]])))
    assert [a for a, _ in cut] == [0, *[b for _, b in cut[:-1]]] and cut[-1][1] == len(sizes) + 1
    held = [0, *sizes]
    assert all(sum(held[a:b]) <= knowledge.BYTES or b == a + 1 for a, b in cut) and len(cut) > 4
    texts = [None, "", "  \n", "short", "Words. " * 400, "é" * 2000, "a\n" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1)
    got = sorted((r.k, r.p, r.c) for r in knowledge.text_chunks(df, "t", "p", "c").collect())
    assert got == [(k, p, c) for k, t in enumerate(texts) for p, c in enumerate(tx.chunk_text(t or ""))]
    assert knowledge.text_chunks(df.limit(0), "t", "p", "c").count() == 0


def test_voices_ask_the_state_store_little():
    """A key's samples cost one read, one write and one timer in place of the one before; timers aren't listed."""
    calls, held = [], {}

    class Handle:
        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

        def deleteTimer(self, at):
            calls.append(f"delete {at}")

        def registerTimer(self, at):
            calls.append(f"register {at}")

    voices = live.Voices(10)
    voices.init(Handle())
    frame = lambda *rows: pd.DataFrame(rows, columns=["ms", "sample", "vector"])
    assert list(voices.handleInputRows((7,), iter([frame((5, 1, [3.0, 4.0]))]), None)) == []
    (got,) = voices.handleInputRows((7,), iter([frame((90, 3, [1.0, 0.0]), (6, 2, [3.0, 4.0])), frame((50, 1, [0.0, 2.0]))]), None)
    assert calls == ["get", "register 16", "update", "get", "delete 16", "register 101", "update"]
    assert got.drop(columns="voice").values.tolist() == [[7, 5, 6, 2], [7, 50, 50, 1]] and got["voice"][1] == [0.0, 1.0]


def test_pieces_don_t_depend_on_the_words_remembered(spark, small):
    """A worker that remembers a few words gives the same pieces, whole texts included."""
    from colloquy.llm import piece_codec

    docs, model = spark.read.parquet(f"{small}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")
    few, many = (sorted(piece_codec.piece_digests(docs, model, keep_ids=True, keep_text=False, words=n).select("doc_id", "ids_sha256", "decoded_sha256", "piece_ids").collect()) for n in (40, piece_codec.WORDS))
    assert few == many and len(few) == docs.count()
