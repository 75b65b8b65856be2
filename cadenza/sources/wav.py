"""WAV files as a Spark data source, and their headers as a column function.

The source's partitions are sample ranges, so a long file is read by many tasks, each of which seeks to its own bytes.
Rows: path, first sample, sample rate, channels, and the mono samples of a chunk. It opens files by path, so it is for
file systems that all machines mount; `read_wav` goes through Spark's own reader and works on any store, with a whole
file (2 GB at most) in one task. Registered as "wav":

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("chunk", 48000).load("/data/*.wav")

Accepted: RIFF/WAVE with integer PCM of 8 (unsigned), 16, 24 or 32 bits or floats of 32 or 64, also in the extensible
form. A malformed file raises with the reason; `header` gives that reason as a column instead.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = "struct<channels:int,sample_rate:int,bits:int,format:string,block_align:int,data_offset:long,data_bytes:long,frames:long,duration_sec:double,error:string>"
ROWS = "path string, first_sample long, sample_rate int, channels int, samples array<float>"
_SEARCHED = 8 << 20  # bytes of a file in which its chunks must start
_INT, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    channels: int
    sample_rate: int
    bits: int
    kind: int
    data_offset: int
    data_bytes: int

    @property
    def block(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return self.data_bytes // self.block


def parse_header(head: bytes, size: int) -> Layout:
    """Layout of a WAV file from its first bytes and its size; data beyond the file's end is cut off."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= min(len(head), _SEARCHED):
        name, length = struct.unpack_from("<4sI", head, at)
        body = at + 8
        if name == b"fmt ":
            if length < 16 or body + 16 > len(head):
                raise ValueError("format chunk too short")
            kind, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", head, body)
            if kind == _EXTENSIBLE:
                if length < 40 or body + 26 > len(head):
                    raise ValueError("extensible format chunk too short")
                kind = struct.unpack_from("<H", head, body + 24)[0]
            fmt = (kind, channels, rate, block, bits)
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before format")
            kind, channels, rate, block, bits = fmt
            if (kind, bits) not in {(_INT, 8), (_INT, 16), (_INT, 24), (_INT, 32), (_FLOAT, 32), (_FLOAT, 64)}:
                raise ValueError(f"unsupported format {kind} with {bits} bits")
            if not channels or not rate or block != channels * bits // 8:
                raise ValueError("inconsistent format chunk")
            there = max(0, min(length, size - body))
            return Layout(channels, rate, bits, kind, body, there // block * block)
        at = body + length + (length & 1)
    raise ValueError("no data chunk")


def decode(raw: bytes, layout: Layout) -> np.ndarray:
    """(frames, channels) samples from -1 to 1."""
    if layout.kind == _FLOAT:
        x = np.frombuffer(raw, f"<f{layout.bits // 8}").astype(np.float32)
    elif layout.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif layout.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8).astype(np.float32) / 8388608
    else:
        x = np.frombuffer(raw, f"<i{layout.bits // 8}").astype(np.float32) / float(1 << (layout.bits - 1))
    return x.reshape(-1, layout.channels)


def encode(samples: np.ndarray, sample_rate: int, channels: int = 1, bits: int = 32) -> bytes:
    """A canonical WAV file of interleaved samples: 32-bit floats, or integers of 16 or 24 bits (clipped)."""
    x = np.asarray(samples, np.float32)
    if bits == 32:
        kind, raw = _FLOAT, x.astype("<f4").tobytes()
    else:
        most = (1 << (bits - 1)) - 1
        whole = np.floor(np.clip(x, -1, 1) * most + 0.5).astype("<i4")
        kind, raw = _INT, whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    block = channels * bits // 8
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, sample_rate, sample_rate * block, block, bits)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(raw), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(raw)) + raw


def header(content):
    """The header of each file's bytes as a struct column, or the reason why it has none in `error`."""

    def one(raw):
        try:
            h = parse_header(bytes(raw[:_SEARCHED]), len(raw))
        except (ValueError, TypeError) as e:
            return (None,) * 9 + (str(e),)
        return (h.channels, h.sample_rate, h.bits, "float" if h.kind == _FLOAT else "int", h.block, h.data_offset, h.data_bytes, h.frames, h.frames / h.sample_rate, None)

    names = [f.split(":")[0] for f in HEADER[7:-1].split(",")]

    @F.pandas_udf(HEADER)
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in raw], columns=names)

    return run(content)


def read_wav(spark, path: str, chunk: int = 48_000):
    """The rows of the source from any store that Spark reads, by way of its binary files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                layout = parse_header(bytes(raw[:_SEARCHED]), len(raw))
                for a in range(0, layout.frames, chunk):
                    b = min(a + chunk, layout.frames)
                    at = layout.data_offset
                    mono = decode(bytes(raw[at + a * layout.block : at + b * layout.block]), layout).mean(axis=1)
                    yield pd.DataFrame({"path": [name], "first_sample": [a], "sample_rate": [layout.sample_rate], "channels": [layout.channels], "samples": [mono]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(rows, ROWS)


@dataclass
class _Range(InputPartition):
    path: str
    layout: Layout
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.chunk, self.per_task = options["path"], int(options.get("chunk", 48_000)), int(options.get("task", 4_800_000))

    def partitions(self):
        out = []
        for path in sorted(p for pattern in self.paths.split(",") for p in (glob.glob(os.path.join(pattern, "**", "*.wav"), recursive=True) if os.path.isdir(pattern) else glob.glob(pattern))):
            with open(path, "rb") as f:
                layout = parse_header(f.read(_SEARCHED), os.path.getsize(path))
            step = max(1, self.per_task // self.chunk) * self.chunk
            out += [_Range(path, layout, a, min(a + step, layout.frames)) for a in range(0, layout.frames, step)]
        return out or [_Range("", Layout(1, 1, 16, _INT, 0, 0), 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.path:
            with open(part.path, "rb") as f:
                for a in range(part.first, part.last, self.chunk):
                    b = min(a + self.chunk, part.last)
                    f.seek(part.layout.data_offset + a * part.layout.block)
                    mono = decode(f.read((b - a) * part.layout.block), part.layout).mean(axis=1)
                    yield part.path, a, part.layout.sample_rate, part.layout.channels, mono.tolist()


class _Writer(DataSourceWriter):
    """One file for each row (name, sample_rate, samples); written under another name first, then renamed."""

    def __init__(self, options: dict):
        self.folder, self.bits = options["path"], int(options.get("bits", 32))

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for row in rows:
            path = os.path.join(self.folder, os.path.basename(row["name"]))
            with open(f"{path}.part-{os.getpid()}", "wb") as f:
                f.write(encode(np.array(row["samples"]), row["sample_rate"], 1, self.bits))
            os.replace(f.name, path)
        return WriterCommitMessage()


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)
