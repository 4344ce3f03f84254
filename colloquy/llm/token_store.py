"""Token ids in ORC: encoded texts in ascending document order, written as files that are read stripe by stripe.

Layout. Each row is (doc_id long, n_tokens long, ids array<int>). Rows are range-partitioned and sorted by doc_id, so
every file and stripe covers one range of ids; ORC stores the integers run-length encoded (RLE v2), keeps row indexes
with the least and largest doc_id every `orc.row.index.stride` rows, and a Bloom filter on doc_id. A lookup by doc_id
therefore reads the footers and the one stripe that can hold it, and stripes are read in parallel.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import delete, materialize, shared_dir, text_of
from .hashing import Memo, slices, words_of
from .worker import owned

MARKS = b".,:;!?()"
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,:;!?()]*$"  # letters, then MARKS: two pre-tokens at most
STRIPE, STRIDE = 64 << 20, 10_000  # bytes of a stripe, rows of an index entry
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

def file_number() -> Column:
    """The number that Spark gives each file of a write: files of ascending number hold ascending ranges."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")


class Words:
    """Ids of texts. White space never lies within a token, so texts are cut there, and a word is encoded once a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo = Memo(self.learn)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words are encoded many to a text, as the token that ends a pre-token says so in its name, others one by one."""
        plain = pc.match_substring_regex(pa.array(words, pa.binary()).cast(pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        marks = np.fromiter((w[-1] in MARKS for w in words), bool, len(words))
        ids: list[np.ndarray] = []
        sizes = np.zeros(len(words), np.int64)
        at, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        for k in range(0, len(at), 2000):
            own = at[k : k + 2000]
            joined = b" ".join([words[i] for i in own.tolist()]).decode()
            got = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            ends, pieces = np.flatnonzero(self.ends[got]) + 1, np.cumsum(1 + marks[own])
            if len(ends) != pieces[-1] or ends[-1] != len(got):
                raise ValueError("a plain word is not one or two pre-tokens")
            sizes[own] = np.diff(ends[pieces - 1], prepend=0)
            ids.append(got)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([words[i].decode() for i in odd.tolist()], add_special_tokens=False)]
        sizes[odd] = list(map(len, others))
        ids.append(np.fromiter(chain.from_iterable(others), np.int32))
        order, flat = np.concatenate([at, odd]), np.concatenate([np.zeros(0, np.int32), *ids])
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        cut = np.cumsum(sizes) - sizes
        return flat[np.repeat(begin - cut, sizes) + np.arange(sizes.sum())], sizes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and each text's number of them."""
        data, start, end, count = words_of(texts)
        ids, cut = self.memo.ids(data, start, end)
        return ids, np.diff(cut[np.concatenate([[0], np.cumsum(count)])])


def words(path: str) -> Words:
    return owned(("words", path), lambda: Words(path))


def checksums(ids: pa.ListArray) -> pa.Array:
    """The crc32 of each list, as little-endian 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes()
    at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]) * 4
    return pa.array(np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])), np.int64, len(ids)))


def encoder(path: str, end_id: int):
    def encode(batches):
        w = words(path)
        for batch in batches:
            for k, texts in slices(batch.column("text"), rows=4096, lower=False, size=4 << 20):
                ids, sizes = w.encode(texts)
                ids, ends = np.insert(ids, np.cumsum(sizes), end_id), np.cumsum(sizes + 1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, len(texts)).cast(pa.int64()), pa.array(sizes + 1), lists, checksums(lists)], names=["doc_id", "n_tokens", "ids", "crc"])

    return encode


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, partitions: int | None = None, stripe: int = STRIPE, stride: int = STRIDE) -> str:
    """Encode every whole text (null: empty), append end_id, and write ORC files in ascending doc_id order.

    Rows of one doc_id (repeated or null ones, which come first) stand next to each other, in a file in the order of their ids'
    checksums, as token_digests() reads them. An empty table gives a folder without rows. Columns other than doc_id and text aren't stored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).mapInArrow(encoder(tokenizer, end_id), T.StructType([*SCHEMA, T.StructField("crc", T.LongType())]))
    (
        encoded.sortWithinPartitions("doc_id", "crc", "n_tokens")
        .drop("crc")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe))
        .orc(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All rows; a file's stripes are read by different tasks where it is longer than spark.sql.files.maxPartitionBytes."""
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some ids. The filter reaches the ORC reader, which leaves out files, stripes and row groups whose least
    and largest doc_id or Bloom filter exclude them all."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(doc_ids))


def token_digests(tokens: DataFrame) -> DataFrame:
    """Per stored row: doc_id, start (ids of all rows before it), n_tokens and ids_crc32.

    Starts come from two levels, so that no task sees all rows: totals of each file, added up over the (few) files,
    and running sums within a file.
    """

    def crc(batches):
        for batch in batches:
            cols = [batch.column(c) for c in ("file", "doc_id", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, checksums(batch.column("ids"))], names=["file", "doc_id", "n_tokens", "ids_crc32"])

    located = tokens.select(file_number().alias("file"), "doc_id", "n_tokens", "ids")
    rows = located.mapInArrow(crc, "file long, doc_id long, n_tokens long, ids_crc32 long")
    files = tokens.select(file_number().alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("file").orderBy("doc_id", "ids_crc32", "n_tokens")
    return (
        rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(before, "file")
        .select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
    )


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """The digests of the token files, written to the shared folder and read back; the files go when they are digested.

    Nulls, repeated rows and empty tables as for write_tokens(); columns other than doc_id and text aren't returned.
    """
    spark = docs.sparkSession
    path = write_tokens(docs, tokenizer, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}", end_id)
    digests = materialize(token_digests(read_tokens(spark, path)), "digests")
    delete(spark, path)
    return digests
