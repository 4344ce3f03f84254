"""The knowledge index: chunks with vectors, stored in shards, replaced a project at a time in one commit.

The index is a folder of Parquet files, partitioned by `shard`, a hash of the project. Replacing some projects' chunks
writes the shards of these projects anew, without their old chunks and with the new ones; Spark stages the files and puts all
shards in place when the whole job is done, so a job that fails leaves the index as it was. Projects are hashed rather
than made partitions each, as a million projects would make a million folders. Chunks that stay go from file to file without a shuffle, so
a replacement takes the disk of the old shards, the new ones and the chunks that change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .shared import maybe_in, written

BATCH = 256  # texts that a model gets at a time
COLUMNS = ["id", "text", "source_type", "project_id", "metadata_json", "vector"]
STEPS = (1, 31, 961)  # weights of the code points of a gram
SIGN = 8191


class HashedGrams:
    """An embedder without a model file: counts of hashed character grams (one to three letters) with signs, normalised.

    A gram's hash is the sum of its code points, each times its step, plus its length; its remainder by the dimension is the gram's place,
    and the parity of its remainder by SIGN the gram's sign. A text without characters has the zero vector.
    """

    def __init__(self, dimension: int = 512):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
            for n in range(1, min(3, len(points)) + 1):
                h = n + sum(STEPS[k] * points[k : len(points) - n + 1 + k] for k in range(n))
                row += np.bincount(h % self.dimension, weights=np.where(h % SIGN % 2 == 0, 1.0, -1.0), minlength=self.dimension)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


_MODELS: dict = {}


def embed(rows: DataFrame, model: Callable[[], object], name: str, text: str = "text", vector: str = "vector", batch: int = BATCH) -> DataFrame:
    """rows with the vector of each text. `model()` makes the object whose encode(list of texts) gives a matrix; a worker makes it
    once (by name) and gives it bounded batches, whatever the size of Arrow's. Null texts are empty."""
    kept = [c for c in rows.columns if c != vector]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(vector, T.ArrayType(T.FloatType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = model()
        for whole in batches:
            for k in range(0, len(whole), batch):
                some = whole.slice(k, batch)
                found = np.asarray(_MODELS[name].encode(pc.fill_null(some.column(text), "").to_pylist()), np.float32)
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * (found.shape[1] if len(found) else 0))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[*kept, vector])

    return rows.select(*kept).mapInArrow(encode, schema)


def chunk_id() -> Column:
    """An id that a chunk keeps when its project is indexed again from the same contents."""
    return F.sha2(F.to_json(F.struct("project_id", "source_type", "metadata_json", "position", "text")), 256)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """All chunks, or None where there is no index yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found.select(*COLUMNS, "shard")


def _dimension(chunks: DataFrame) -> int | None:
    row = chunks.select(F.size("vector").alias("n")).filter("n > 0").limit(1).collect()
    return row[0]["n"] if row else None


def _sharded(chunks: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(F.col("project_id").cast("string")), F.lit(shards)).cast("int")
    return chunks.select(*COLUMNS, shard.alias("shard"))


#: Spark counts 4 MB for opening a file: a task reads as many small files of shards as have its size together.
_SMALL_FILES = {"spark.sql.files.openCostInBytes": "64k"}
#: A job's shuffle files go when it ends, not when the driver happens to collect its garbage.
_NO_REMAINS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(chunks: DataFrame, path: str, mode: str, replaced: str = "dynamic") -> None:
    with _set(chunks.sparkSession, _NO_REMAINS):
        chunks.write.mode(mode).option("partitionOverwriteMode", replaced).option("compression", "zstd").partitionBy("shard").parquet(path)


def _gathered(chunks: DataFrame) -> DataFrame:
    """One file a shard, or more where a shard is large."""
    return chunks.hint("rebalance", "shard")


def _without(have: DataFrame, gone: DataFrame) -> DataFrame:
    """The chunks in have of no project in gone. Only those that a Bloom filter can't tell from gone ones are shuffled."""
    maybe = maybe_in(gone, "project_id")
    return have.filter(~maybe).unionByName(have.filter(maybe).join(gone, "project_id", "left_anti"))


def append_chunks(chunks: DataFrame, path: str, shards: int = 64) -> None:
    """Add chunks (COLUMNS) to the index. An index whose vectors have another length is for another embedder: it is dropped first."""
    spark = chunks.sparkSession
    have, new = read_index(spark, path), _dimension(chunks)
    if new is None:
        return
    old = _dimension(have) if have is not None else None
    if old not in (None, new):
        _write(_sharded(chunks, shards), path, "overwrite", "static")
    else:
        _write(_gathered(_sharded(chunks, shards)), path, "append")


def replace_projects(chunks: DataFrame, projects: DataFrame, path: str, shards: int = 64) -> None:
    """Index projects (project_id) anew: all their chunks in the index go, those given take their place, other projects' stay.

    Projects without chunks have none afterwards. It is one commit: readers see the old index until all is written, and a failed
    job changes nothing. An index of vectors of another length is dropped, as append_chunks() does.
    """
    spark = chunks.sparkSession
    have = read_index(spark, path)
    if have is None:
        _write(_sharded(chunks, shards), path, "overwrite", "static")
        return
    with _set(spark, _NO_REMAINS):
        new = written(_sharded(chunks, shards), "chunks")  # computed once, and a failure comes before any change
    size = _dimension(new)
    if size is not None and _dimension(have) not in (None, size):
        _write(new, path, "overwrite", "static")
        return
    gone = written(projects.select(F.col("project_id").cast(have.schema["project_id"].dataType)).distinct(), "gone")
    touched = _sharded(gone.select(*[F.col("project_id") if c == "project_id" else F.lit(None).alias(c) for c in COLUMNS]), shards).select("shard").distinct()
    numbers = [r["shard"] for r in touched.collect()]  # shards at most
    kept = _without(have.filter(F.col("shard").isin(numbers)), gone).select(*COLUMNS, "shard")
    with _set(spark, _SMALL_FILES):
        emptied = set(numbers) - {r["shard"] for r in kept.select("shard").unionByName(new.select("shard")).distinct().collect()}
        mark = spark.createDataFrame([(n,) for n in sorted(emptied)], "shard int").select(*[F.lit(None).cast(have.schema[c].dataType).alias(c) for c in COLUMNS], "shard")  # an empty shard can't be written: one blank row
        _write(kept.unionByName(_gathered(new.select(*COLUMNS, "shard"))).unionByName(mark), path, "overwrite")


def delete_projects(projects: DataFrame, path: str, shards: int = 64) -> None:
    """Take all chunks of projects (project_id) out of the index, in one commit."""
    have = read_index(projects.sparkSession, path)
    if have is not None:
        replace_projects(have.select(*COLUMNS).limit(0), projects, path, shards)


def chunks_of(spark: SparkSession, path: str, project_ids=None, shards: int = 64) -> DataFrame | None:
    """The index's chunks, of some projects if asked for: their shards alone are read."""
    found = read_index(spark, path)
    if found is None:
        return None
    found = found.filter("id is not null")
    if not project_ids:
        return found
    ids = sorted(set(project_ids))
    asked = spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("project_id", found.schema["project_id"].dataType)]))
    own = asked.select(F.pmod(F.xxhash64(F.col("project_id").cast("string")), F.lit(shards)).cast("int")).distinct()
    return found.filter(F.col("shard").isin([r[0] for r in own.collect()]) & F.col("project_id").isin(ids))
