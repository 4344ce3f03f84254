"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 27  # of a Bloom filter, at most: 16 MB
SLOT = 1 << 16  # bits that a task packs at a time


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master gets a temporary folder, and a cluster is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: its Parquet files outlive executors, so a lost one costs its running tasks only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_in(keys: DataFrame, key: str) -> Column:
    """Whether a row's key may be among keys (a written table of distinct keys, of the rows' type): a Bloom filter of BITS at most. It is
    never false for one of them; beyond that size it is true for more others, too."""
    size = 1 << int(np.clip(np.ceil(np.log2(max(keys.count(), 1) * 16)), 16, np.log2(BITS)))
    places = [F.pmod(F.xxhash64(F.lit(k), key), F.lit(size)) for k in (2, 3)]

    def packed(slot, table):
        bits = np.zeros(SLOT, bool)
        bits[table.column("p").to_numpy() % SLOT] = True
        return pa.table({"slot": [slot[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = keys.select(F.explode(F.array(*places)).alias("p")).distinct().withColumn("slot", F.floor(F.col("p") / SLOT))
    table = np.zeros(size // 8, np.uint8)
    for r in found.groupBy("slot").applyInArrow(packed, "slot long, bits binary").collect():  # size / 8 bytes
        table[r["slot"] * SLOT // 8 : (r["slot"] + 1) * SLOT // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        bits, (a, b) = shared.value, (a.to_numpy(), b.to_numpy())
        return pd.Series((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

    return maybe(*places)
