"""Reading and writing the store's tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace-all per key: only the partitions of the keys in df are overwritten, when the whole job has committed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def document_text(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """binaryFile rows -> (path, text): plain text by suffix, other suffixes by the given parsers, else ''."""
    plain = {"txt", "md", "csv"}
    parsers = parsers or {}

    @F.pandas_udf("string")
    def text(paths: pd.Series, contents: pd.Series) -> pd.Series:
        def one(path, content):
            suffix = path.rsplit(".", 1)[-1].lower()
            if content is None:
                return ""
            return bytes(content).decode("utf-8", "ignore") if suffix in plain else parsers[suffix](bytes(content)) if suffix in parsers else ""

        return pd.Series([one(p, c) for p, c in zip(paths, contents)], dtype=object)

    return files.select("path", text("path", "content").alias("text"))


def wav_samples(data: bytes) -> list[int]:
    """16-bit samples after the fixed 44-byte header; shorter files are an error."""
    if len(data) < 44:
        raise ValueError("a WAV file has 44 bytes at least")
    n = (len(data) - 44) // 2
    return list(struct.unpack(f"<{n}h", data[44 : 44 + 2 * n]))


def imported(have: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Rows of an older store (of equal columns) added where their key isn't there yet; a second run adds nothing."""
    return have.unionByName(legacy.select(*have.columns).dropDuplicates([key]).join(have.select(key), key, "left_anti").select(*have.columns))
