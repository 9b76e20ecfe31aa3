"""WAV files as a Spark data source: each task reads a byte range of a file, so that a long recording is the work of many.

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("chunk", 44100).load("/recordings/*.wav")

Files are opened where the tasks run, so their folder is one that all machines mount; what only Spark can
open is read by tables.read_wav(), a file a task.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "session_id string, chunk_no int, rate int, samples array<float>"
#: Kinds of data chunk: whole numbers, floats, and those whose kind stands further on in their header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Header:
    """Where a file's samples stand, and how they are kept."""

    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    size: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.bits // 8


def header(path: str) -> Header:
    """Reads a file's chunk headers, and no samples; a data chunk that claims more than there is ends with the file."""
    with open(path, "rb") as file:
        top = file.read(12)
        if top[:4] != b"RIFF" or top[8:] != b"WAVE":
            raise ValueError(f"{path} is no WAV file")
        found: dict[bytes, bytes] = {}
        while len(name := file.read(8)) == 8:
            size = int.from_bytes(name[4:], "little")
            if name[:4] == b"data":
                start = file.tell()
                format_ = found[b"fmt "]
                kind, channels, rate, bits = (int.from_bytes(format_[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
                if kind == EXTENSIBLE:
                    kind = int.from_bytes(format_[24:26], "little")
                return Header(kind, channels, rate, bits, start, min(size, file.seek(0, 2) - start))
            found[name[:4]] = file.read(size) if size < 1 << 16 else b""
            if size >= 1 << 16:
                file.seek(size, 1)
            file.seek(size % 2, 1)
    raise ValueError(f"{path} has no samples")


def mono(raw: bytes, of: Header) -> np.ndarray:
    """Samples of all channels as their mean, from -1 to 1."""
    if (of.kind, of.bits) == (PCM, 8):
        values = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif (of.kind, of.bits) in ((PCM, 16), (PCM, 32)):
        values = np.frombuffer(raw, f"<i{of.bits // 8}").astype(np.float64)
    elif (of.kind, of.bits) == (PCM, 24):
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        values = (wide.view("<i4").ravel() >> 8).astype(np.float64)
    elif of.kind == FLOAT:
        return np.frombuffer(raw, f"<f{of.bits // 8}").astype(np.float64).reshape(-1, of.channels).mean(axis=1).astype(np.float32)
    else:
        raise ValueError(f"samples of kind {of.kind} with {of.bits} bits are not read")
    return (values.reshape(-1, of.channels).mean(axis=1) / 2 ** (of.bits - 1)).astype(np.float32)


@dataclass
class Range(InputPartition):
    """Chunks first to end (excluded) of a file."""

    path: str
    first: int
    end: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(options["path"].removeprefix("file://")))
        self.chunk = int(options.get("chunk", 44100))
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        made: list[InputPartition] = []
        for path in self.paths:
            of = header(path)
            n = -(-(of.size // of.frame_bytes) // self.chunk)
            step = max(1, self.range_bytes // (of.frame_bytes * self.chunk))
            made += [Range(path, a, min(n, a + step)) for a in range(0, n, step)]
        return made or [Range(self.paths[0], 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        of = header(partition.path)
        with open(partition.path, "rb") as file:
            for n in range(partition.first, partition.end):
                start = n * self.chunk * of.frame_bytes
                file.seek(of.start + start)
                size = min(self.chunk * of.frame_bytes, of.size - start)
                samples = mono(file.read(size - size % of.frame_bytes), of)
                columns = [pa.array([partition.path]), pa.array([n], pa.int32()), pa.array([of.rate], pa.int32()), pa.array([samples], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, ["session_id", "chunk_no", "rate", "samples"])


class WavSource(DataSource):
    """session_id (the file), chunk_no, rate, samples (mono, -1 to 1); options: path (a pattern), chunk (samples), rangeBytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WavReader:
        return WavReader({name.lower(): value for name, value in self.options.items()})
