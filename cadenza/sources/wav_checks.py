"""Strict checks of WAV files, as rows: a named refusal where a lenient reader would cut or guess, and bounded windows.

`inspect` walks all chunks of a file and refuses overruns, doubles and sizes that do not add up, then whatever the limits
exclude, then float samples that are not finite or leave -1..1. `mono_float` is the narrower check of what windows are cut
from; it looks only at a file's first bytes, and windows are sliced from its binary by Spark, so that no sample passes
through Python.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc

INFO = "struct<format:int,sample_rate:int,channels:int,width_bytes:int,frames:long,duration_sec:double,data_offset:long,data_bytes:long,error:string>"
MONO = "struct<sample_rate:int,data_offset:long,data_bytes:long,samples:long,error:string>"
#: Format codes, the GUIDs of extensible formats, the longest format chunk, and how far a prefix is read.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
GUIDS = {bytes.fromhex("0100000000001000800000aa00389b71"): PCM, bytes.fromhex("0300000000001000800000aa00389b71"): FLOAT}
LONGEST_FORMAT, LONGEST_PREFIX = 4096, 4 << 20


class Refused(ValueError):
    pass


def need(good: bool, reason: str) -> None:
    if not good:
        raise Refused(reason)


@dataclass(frozen=True)
class Limits:
    most_bytes: int = 1 << 30
    rates: frozenset = frozenset({8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000})
    channels: frozenset = frozenset({1, 2})
    widths: frozenset = frozenset({2, 3, 4})
    most_seconds: float = 2160.0
    most_frames: int = 1 << 31


@dataclass(frozen=True)
class Format:
    code: int
    channels: int
    rate: int
    byte_rate: int
    block: int
    bits: int


def chunks(raw: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, length) of each chunk; a chunk of odd length is followed by one byte more, which must be there."""
    at = 12
    while at < len(raw):
        need(at + 8 <= len(raw), "truncated chunk header")
        name, length = struct.unpack_from("<4sI", raw, at)
        end = at + 8 + length + length % 2
        need(end <= len(raw), "truncated chunk")
        yield name, at + 8, length
        at = end


def read_format(payload: bytes) -> Format:
    code, channels, rate, byte_rate, block, bits = struct.unpack_from("<HHIIHH", payload)
    if code == EXTENSIBLE:
        need(len(payload) >= 40, "invalid extensible format chunk")
        extra, valid = struct.unpack_from("<HH", payload, 16)
        need(22 <= extra <= len(payload) - 18, "invalid extensible format size")
        need(valid == bits, "unsupported extensible valid-bit width")
        need(payload[24:40] in GUIDS, "unsupported extensible WAV subformat")
        code = GUIDS[payload[24:40]]
    return Format(code, channels, rate, byte_rate, block, bits)


def layout(raw: bytes) -> tuple[Format, int, int]:
    """The format, and where the samples are: (format, first byte, length)."""
    need(len(raw) >= 44 and raw[:4] == b"RIFF" and raw[8:12] == b"WAVE", "not a RIFF/WAVE file")
    need(struct.unpack_from("<I", raw, 4)[0] == len(raw) - 8, "RIFF size does not match uploaded bytes")
    form, data = None, None
    for name, at, length in chunks(raw):
        if name == b"fmt ":
            need(form is None and 16 <= length <= LONGEST_FORMAT, "invalid format chunk")
            form = read_format(raw[at : at + length])
        elif name == b"data":
            need(data is None, "multiple data chunks")
            data = at, length
    need(form is not None and data is not None, "missing required WAV chunks")
    return form, *data


def hold(form: Format, at: int, length: int, size: int, limits: Limits) -> int:
    """The number of frames, if the limits allow the file."""
    width = form.bits // 8
    need(form.bits > 0 and form.bits % 8 == 0, "invalid PCM sample width")
    need(form.code in (PCM, FLOAT), "only integer PCM or IEEE float32 WAV is accepted")
    need(form.code == PCM or form.bits == 32, "IEEE float WAV must use 32-bit samples")
    need(form.rate in limits.rates, "sample rate outside allowlist")
    need(form.channels in limits.channels, "channel count outside allowlist")
    need(width in limits.widths, "sample width outside allowlist")
    need(form.block == form.channels * width and form.byte_rate == form.rate * form.block, "inconsistent WAV format math")
    need(length > 0 and length % form.block == 0, "invalid audio data length")
    need(at >= 20 and at + length <= size, "invalid audio data bounds")
    frames = length // form.block
    need(frames / form.rate <= limits.most_seconds, "duration exceeds limit")
    need(frames <= limits.most_frames, "decoded frame count exceeds limit")
    return frames


def hold_samples(raw: bytes, at: int, length: int) -> None:
    """Refuse by the first float sample that is not finite or out of range, part by part."""
    for a in range(at, at + length, 1 << 22):
        x = np.frombuffer(raw, "<f4", count=min(1 << 20, (at + length - a) // 4), offset=a)
        bad = np.flatnonzero(~(np.abs(x) <= 1))
        if len(bad):
            raise Refused("out-of-range-float-samples" if np.isfinite(x[bad[0]]) else "non-finite-float-samples")


def inspected(raw: bytes | None, limits: Limits = Limits()) -> tuple:
    """The fields of INFO; all but the error are null for a refused file."""
    try:
        need(raw is not None, "no file")
        need(len(raw) <= limits.most_bytes, "upload exceeds byte limit")
        form, at, length = layout(raw)
        frames = hold(form, at, length, len(raw), limits)
        if form.code == FLOAT:
            hold_samples(raw, at, length)
    except Refused as e:
        return (None,) * 8 + (str(e),)
    return form.code, form.rate, form.channels, form.bits // 8, frames, frames / form.rate, at, length, None


def _rows(kind: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split(":")[0] for f in kind[7:-1].split(",")], dtype=object)


def inspect(content: Column, limits: Limits = Limits()) -> Column:
    """INFO of each file's bytes."""

    @F.pandas_udf(INFO)
    def run(content: pd.Series) -> pd.DataFrame:
        return _rows(INFO, [inspected(x, limits) for x in content])

    return run(content)


def mono_prefix(head: bytes | None, size: int) -> tuple:
    """The fields of MONO from a file's first bytes: one channel of 32-bit floats, up to its data chunk."""
    try:
        need(head is not None and size >= 44, "WAV is too small for bounded QC.")
        need(head[:4] == b"RIFF" and head[8:12] == b"WAVE", "Bounded QC expects a RIFF/WAVE container.")
        at, rate, good = 12, 0, False
        while at + 8 <= len(head):
            name, length = struct.unpack_from("<4sI", head, at)
            start, end = at + 8, at + 8 + length
            need(end <= size, f"Corrupt WAV: {name.decode('latin-1').strip() or 'unknown'} chunk exceeds the file.")
            if name == b"data":
                need(good, "Bounded QC expects mono pcm_f32le audio.")
                need(length > 0 and length % 4 == 0, "Corrupt WAV: missing or misaligned float32 audio data.")
                return rate, start, length, length // 4, None
            if name == b"fmt ":
                need(length >= 16, "Corrupt WAV: incomplete fmt chunk.")
                need(start + 16 <= len(head), "WAV metadata prefix exceeds the bounded inspection limit.")
                code, channels, rate, byte_rate, block, bits = struct.unpack_from("<HHIIHH", head, start)
                if code == EXTENSIBLE and length >= 40 and start + 26 <= len(head) and struct.unpack_from("<H", head, start + 18)[0] == 32:
                    code = struct.unpack_from("<H", head, start + 24)[0]
                good = code == FLOAT and (channels, bits, block) == (1, 32, 4) and rate > 0 and byte_rate == rate * 4
            at = end + length % 2
        need(at + 8 > size or len(head) >= size, "WAV metadata prefix exceeds the bounded inspection limit.")
        need(good, "Bounded QC expects mono pcm_f32le audio.")
        raise Refused("Corrupt WAV: missing or misaligned float32 audio data.")
    except Refused as e:
        return (None,) * 4 + (str(e),)


def mono_float(content: Column) -> Column:
    """MONO of each file's bytes, of which Python sees only the first."""

    @F.pandas_udf(MONO)
    def run(head: pd.Series, size: pd.Series) -> pd.DataFrame:
        return _rows(MONO, [mono_prefix(h, 0 if n is None or n != n else int(n)) for h, n in zip(head, size)])

    return run(F.substring(content, 1, LONGEST_PREFIX), F.octet_length(content).cast("long"))


def _little(x: Column, size: int = 4) -> Column:
    """A whole number as little-endian bytes."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(255)), 2, "0")) for k in range(size)))


def canonical_header(rate: Column, data_bytes: Column) -> Column:
    """The 44 bytes before the samples of one channel of 32-bit floats."""
    text = lambda s: F.unhex(F.lit(s.encode().hex()))
    number = lambda x, n: F.unhex(F.lit(x.to_bytes(n, "little").hex()))
    form = F.concat(text("fmt "), number(16, 4), number(FLOAT, 2), number(1, 2), _little(rate), _little(rate * 4), number(4, 2), number(32, 2))
    return F.concat(text("RIFF"), _little(data_bytes + 36), text("WAVE"), form, text("data"), _little(data_bytes))


def window(content: Column, info: Column, start_sec: Column, duration_sec: Column) -> Column:
    """struct<bytes, start_sample, sample_count, duration_sec, error>: a file of its own of a stretch of a file with `mono_float` info.

    Times are rounded to samples, halves upward; the end is cut at the file's, and at least one sample is asked for.
    """
    rate, total = info["sample_rate"], info["samples"]
    start_fits = F.coalesce(sc.is_finite(start_sec) & (start_sec >= 0), F.lit(False))
    long_enough = F.coalesce(sc.is_finite(duration_sec) & (duration_sec > 0), F.lit(False))
    first = F.least(total, sc.half_up(start_sec * rate).cast("long"))
    many = F.least(F.greatest(F.lit(1), sc.half_up(duration_sec * rate).cast("long")), total - first)
    error = F.coalesce(
        info["error"], F.when(~start_fits, "Bounded QC window start must be a finite non-negative value."), F.when(~long_enough, "Bounded QC window duration must be a finite positive value."),
        F.when(many <= 0, "Bounded QC window starts after the WAV audio data."),
    )
    cut = F.substr(content, (info["data_offset"] + 4 * first + 1).cast("int"), (4 * many).cast("int"))
    shown = lambda x: F.when(error.isNull(), x)
    return F.struct(
        shown(F.concat(canonical_header(rate, 4 * many), cut)).alias("bytes"), shown(first).alias("start_sample"), shown(many).alias("sample_count"), shown(many / rate).alias("duration_sec"), error.alias("error")
    )
