"""What the operators share: the shared folder, materialised tables, and column hygiene."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BITS = 1 << 27  # of a Bloom filter, at most: 16 MB


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary
    folder of its own; a cluster is refused, as its machines would each write to another disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, group: int | None = None, per_file: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet (in row groups of so many bytes, or files of so many uncompressed rows, if asked for) to the shared folder and read it back.

    The files outlive executors, so a lost executor costs only its running tasks. They go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("parquet.block.size", str(group)) if group else df.write
    (out.option("maxRecordsPerFile", per_file).option("compression", "none") if per_file else out).parquet(path)
    delete(spark, path, at_exit=True)
    written = spark.read.schema(df.schema).parquet(path)
    written._shared_path = path
    return written


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """materialize(), in buckets of the keys: joins on them, however many, spare this table the shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    delete(spark, path, at_exit=True)
    written = spark.table(table)
    written._shared_path, written._table = path, table
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() and bucketed() that no later step reads."""
    for written in tables:
        if hasattr(written, "_table"):
            written.sparkSession.sql(f"DROP TABLE IF EXISTS {written._table}")
        delete(written.sparkSession, written._shared_path)


def delete(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(target) if at_exit else files.delete(target, True)


def semi_join(rows: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in needed (a written table of distinct keys): a semi join, before which a Bloom filter of the
    needed keys, of BITS at most, spares most other rows the shuffle. Beyond that size it lets more rows through, no less."""
    spark = rows.sparkSession
    size = 1 << int(np.clip(np.ceil(np.log2(max(needed.count(), 1) * 16)), 16, np.log2(BITS)))
    places = [F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(size)) for k in (2, 3)]

    def packed(key, table):
        bits = np.zeros(1 << 16, bool)
        bits[table.column("p").to_numpy() & 0xFFFF] = True
        return pa.table({"slot": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    set_bits = needed.select(F.explode(F.array(*places)).alias("p")).distinct().withColumn("slot", F.shiftright("p", 16))
    table = np.zeros(size // 8, np.uint8)
    for r in set_bits.groupBy("slot").applyInArrow(packed, "slot long, bits binary").collect():  # size / 8 bytes
        table[r["slot"] * 8192 : r["slot"] * 8192 + 8192] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        bits, (a, b) = shared.value, (a.to_numpy(), b.to_numpy())
        return pd.Series((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

    return rows.filter(maybe(*places)).join(needed, keys, "left_semi")


def text_of(name: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def without(df: DataFrame, names) -> DataFrame:
    """df without the columns (in any case) that an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
