"""Micro-batch ingestion of PCM frames: count-based windows with state per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import replace_partitions

OUT = "job_id string, window_index long, start double, end double, n_bytes long"
STATE = "left long, index long, elapsed double"


def cut(left: int, index: int, elapsed: float, sizes, window: int, rate: int) -> tuple[list[tuple], tuple]:
    """Whole windows that frames of these sizes complete after what is left, and the new state."""
    rows = []
    left += int(sum(sizes))
    while left >= window:
        seconds = window / rate
        rows.append((index, round(elapsed, 3), round(elapsed + seconds, 3), window))
        left, index, elapsed = left - window, index + 1, elapsed + seconds
    return rows, (left, index, elapsed)


def pcm_windows(frames: DataFrame, sample_rate: int = 16_000, channels: int = 1, seconds: int = 5) -> DataFrame:
    """frames (job_id, seq, pcm) -> a row for each completed window of so many seconds of 16-bit samples. A frame without pcm ends
    its job: what is left becomes a last, shorter window, and the job's state goes."""
    rate = sample_rate * channels * 2
    window = rate * seconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0.0)
        rows, over = [], False
        for pdf in batches:
            over |= bool(pdf["pcm"].isna().any())
            done, held = cut(*held, pdf["pcm"].dropna().map(len), window, rate)
            rows += done
        if over:
            rows += [tail] if (tail := flush_tail(*held, rate)) else []
            state.remove() if state.exists else None
        else:
            state.update(held)
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def running_centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """A stream's mean at each place of the vectors so far of each key: (key, pos, mean, n), for the complete or update mode."""
    return vectors.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def persisted(segments: DataFrame, path: str, key: str, checkpoint: str, every: str = "30 seconds"):
    """Start a query that replaces, each half minute, the stored segments of the meetings that the stream brought."""
    write = segments.writeStream.foreachBatch(lambda df, _: replace_partitions(df, path, key)).trigger(processingTime=every)
    return write.option("checkpointLocation", checkpoint).start()


def flush_tail(left: int, index: int, elapsed: float, rate: int, least: int = 100) -> tuple | None:
    """The last, partial window at the end of a stream, if it has more than a few bytes."""
    return (index, round(elapsed, 3), round(elapsed + left / rate, 3), left) if left > least else None
