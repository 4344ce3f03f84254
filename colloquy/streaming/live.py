"""Live operators: sliding and session windows, voiceprints with state and expiry, and a sink that a replay doesn't change."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VOICE = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("n", T.IntegerType()), T.StructField("began", T.LongType()), T.StructField("last", T.LongType())])


def sliding(events: DataFrame, keys: list[str], at: str, size: str, slide: str, late: str, *sums: Column) -> DataFrame:
    """Aggregates of each key in windows of a size every slide; a window is final, and its state goes, once the stream is `late` past it."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w"), *keys).agg(*sums)
    return windows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in windows.columns if c not in (*keys, "w")])


def sessions(events: DataFrame, keys: list[str], at: str, gap: str, late: str, *sums: Column) -> DataFrame:
    """Aggregates of each key's stretches without a silence of `gap`; a stretch is final once the stream is `late` past its end."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*sums)
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in found.columns if c not in (*keys, "w")])


def blended(old: np.ndarray | None, count: int, new: np.ndarray) -> tuple[np.ndarray, int]:
    """One step of a running voiceprint, as vectors.blend() takes it, and the number of samples after it, 100 at most."""
    if old is None or len(old) != len(new):
        mean, count = new, 0
    else:
        n = min(count, 20)
        mean = old * (n / (n + 1)) + new / (n + 1)
    return mean / max(float(np.linalg.norm(mean)), 1e-12), min(count + 1, 100)


class Voices(StatefulProcessor):
    """A key's running voiceprint. It is given out, and its state goes, when the key has been silent for `quiet` milliseconds: when a
    later sample shows the silence, or by a timer when none comes."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.voice = handle.getValueState("voice", VOICE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.voice.get()
        v, n, began, last = (np.array(state[0]), state[1], state[2], state[3]) if state else (None, 0, None, None)
        if last is not None:
            self.handle.deleteTimer(last + self.quiet + 1)  # the only one that a key has
        parts = list(rows)
        ms, sample, vector = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("ms", "sample", "vector"))
        done = []
        for k in np.lexsort((sample, ms)).tolist():
            at = int(ms[k])
            if last is not None and at - last > self.quiet:
                done.append((began, last, n, v))
                v, n, began = None, 0, None
            v, n = blended(v, n, np.asarray(vector[k], float))
            began, last = at if began is None else began, at
        self.handle.registerTimer(last + self.quiet + 1)
        self.voice.update((v.tolist(), n, began, last))
        if done:
            yield self.found(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        v, n, began, last = self.voice.get()
        self.voice.clear()
        yield self.found(key, [(began, last, n, np.array(v))])

    def close(self) -> None:
        pass

    @staticmethod
    def found(key, done: list[tuple]) -> pd.DataFrame:
        """All of a key's ended stretches, in one frame."""
        began, last, n, v = zip(*done)
        return pd.DataFrame({"key": [key[0]] * len(done), "began_ms": began, "last_ms": last, "n": n, "voice": [x.tolist() for x in v]})


def voices(samples: DataFrame, key: str, at: str, sample: str, vector: str, quiet: float, late: str = "0 seconds") -> DataFrame:
    """samples of keys (long) over time -> (key, began_ms, last_ms, n, voice) for each stretch without `quiet` seconds of silence.

    Needs the RocksDB state store: start the query within rocks(). Samples later than `late` are dropped, as the watermark says.
    """
    rows = samples.withWatermark(at, late).select(F.col(key).alias("key"), at, F.unix_millis(at).alias("ms"), F.col(sample).alias("sample"), F.col(vector).alias("vector"))
    out = "key long, began_ms long, last_ms long, n long, voice array<double>"
    return rows.groupBy("key").transformWithStateInPandas(Voices(int(quiet * 1000)), out, outputMode="Append", timeMode="EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries started within have the RocksDB state store; the session's own setting comes back."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)


def store_batch(path: str):
    """A foreachBatch function that gives each batch a folder of its number: a replayed batch replaces its own rows, and nothing doubles."""

    def store(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return store


def run(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Take all that has arrived, in as many batches as the source makes, into the store; a further call goes on from the checkpoint."""
    query = stream.writeStream.foreachBatch(store_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def arrivals(rows: DataFrame, at: str, folder: str, files: int = 3) -> DataFrame:
    """A stream of rows in the order of time, as if a file of them arrived now and then, and a last row of nulls a year later that ends all windows."""
    spark = rows.sparkSession
    cuts = rows.select(F.percentile_approx(F.unix_micros(at), [k / files for k in range(1, files)]).alias("c")).first()["c"] or []
    us = F.unix_micros(at)
    for low, high in zip([None, *cuts], [*cuts, None]):
        own = rows.filter((F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high))
        own.write.mode("append").parquet(folder)
    end = rows.agg((F.max(at) + F.expr("INTERVAL 366 DAYS")).alias(at)).select(*[F.col(at) if c == at else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)
