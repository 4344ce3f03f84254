"""Recordings as a data source: spark.read.format("wav").load(folder) gives blocks of mono samples, in [-1, 1].

Files are found by Arrow's file systems, so folders may be local or in a store. A long recording is read by many tasks: each takes the
frames that begin within its range of bytes. Headers are read in the tasks, not by the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT, BLOCK = 32 << 20, 1.0  # bytes of a task's range, seconds of a row
HEADER = 44  # bytes of the shortest file
SCHEMA = "path string, block long, start double, rate int, samples array<float>"


def layout(head: bytes, size: int) -> dict:
    """Where a file's samples are, and what they are, from its first bytes: RIFF chunks, or what a plain header of 44 bytes says."""
    if size < HEADER:
        raise ValueError("a WAV file has 44 bytes at least")
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF file of kind WAVE")
    at, form = 12, None
    while at + 8 <= len(head):
        kind, n = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
        elif kind == b"data":
            if form is None:
                raise ValueError("samples before their format")
            code, channels, rate, _, frame, bits = form
            if code == 0xFFFE and at:  # extensible: the format is the first two bytes of a longer one, 24 bytes into the chunk
                code = struct.unpack("<H", head[44:46])[0] if len(head) > 46 else 1
            end = min(size, at + 8 + n) if n not in (0, 0xFFFFFFFF) else size  # recorders that were cut off leave a length of 0
            return {"code": code, "channels": channels, "rate": rate, "frame": frame, "bits": bits, "first": at + 8, "frames": (end - at - 8) // frame}
        at += 8 + n + n % 2
    raise ValueError("no samples within the header's chunks")


def decoded(raw: bytes, form: dict) -> np.ndarray:
    """Samples in [-1, 1], the mean of the channels."""
    kinds = {(1, 16): ("<i2", 1 / 32768, 0.0), (1, 32): ("<i4", 1 / 2147483648, 0.0), (1, 8): ("u1", 1 / 128, -1.0), (3, 32): ("<f4", 1.0, 0.0), (3, 64): ("<f8", 1.0, 0.0)}
    key = form["code"], form["bits"]
    if key == (1, 24):
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) ^ 0x800000) - 0x800000) / 8388608.0
    elif key in kinds:
        kind, scale, shift = kinds[key]
        x = np.frombuffer(raw, kind).astype(np.float64) * scale + shift
    else:
        raise ValueError(f"samples of format {key[0]} with {key[1]} bits can't be read")
    return x.reshape(-1, form["channels"]).mean(axis=1).astype(np.float32)


class Range(InputPartition):
    def __init__(self, path: str, size: int, low: int, high: int):
        self.path, self.size, self.low, self.high = path, size, low, high


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split, self.seconds = int(options.get("splitBytes", SPLIT)), float(options.get("blockSeconds", BLOCK))

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else "file://" + self.path[5:])

    def partitions(self) -> list[Range]:
        store, path = self._store()
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        found = [f for f in files if f.type == fs.FileType.File and f.extension.lower() == "wav"]
        return [Range(f.path, f.size, low, min(low + self.split, max(f.size, 1))) for f in found for low in range(0, max(f.size, 1), self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as file:
            try:
                form = layout(file.read_at(min(partition.size, 1 << 16), 0), partition.size)
                step = max(1, round(self.seconds * form["rate"]))
                blocks = -(-form["frames"] // step)
                place = lambda byte: min(blocks, max(0, -(-(byte - form["first"]) // (step * form["frame"]))))  # noqa: E731  the first block that begins at or after a byte
                for k in range(place(partition.low), place(partition.high)):
                    n = min(step, form["frames"] - k * step) * form["frame"]
                    samples = decoded(file.read_at(n, form["first"] + k * step * form["frame"]), form)
                    row = [[partition.path], [k], [k * step / form["rate"]], [form["rate"]]]
                    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, row, kinds), pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))], names=["path", "block", "start", "rate", "samples"])
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from e


class WavSource(DataSource):
    """Options: splitBytes (of a task's range) and blockSeconds (of a row)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def pcm_file(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 16-bit samples, clipped."""
    raw = (np.clip(np.round(samples * 32768), -32768, 32767)).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(raw)) + raw


def saver(folder: str, key: str, order: str, sample: str, rate: int, scale: float):
    """A function of one recording's rows (for applyInPandas) that writes them, in order, as `<key>.wav` in a folder all executors see. A
    task that runs again writes the same file again."""

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"{path}/{pdf[key].iloc[0]}.wav"
        with store.open_output_stream(name) as out:
            out.write(pcm_file(pdf.sort_values(order)[sample].to_numpy(float) / scale, rate))
        return pd.DataFrame({"path": [name], "samples": [len(pdf)]})

    return save
