"""Frame tables: equi-spaced levels per series, (series, frame_idx, level ...), the input of the ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import to_db


def indexed(df: DataFrame, keys: list[str], order: list[str], out: str = "frame_idx") -> DataFrame:
    """df with a frame index from 0 within each series; `order` must be unique within it."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def levels(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, frame_idx, value and its level in dB."""
    return indexed(df.select(*keys, *order, value), keys, order).select(*keys, "frame_idx", value, to_db(F.col(value)).alias("db"))


def frames_of(samples: Column, size: int) -> Column:
    """Non-overlapping frames of a sample array as array<array>; a rest shorter than a frame is left out."""
    many = F.floor(F.size(samples) / size).cast("int")
    return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.slice(samples, k * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def frame_stats(df: DataFrame, keys: list[str], samples: str, size: int, floor: float = -120.0) -> DataFrame:
    """keys, frame_idx, rms, peak, db and sharpness_db of each frame of the sample arrays.

    Sharpness is the rms of a sample less the mean of its neighbours in the frame; at the edges it is its own
    neighbour.
    """
    frames = df.select(*keys, F.posexplode(frames_of(F.transform(samples, lambda x: x.cast("double")), size)).alias("frame_idx", "__x"))
    x = F.col("__x")

    def neighbour(i: Column) -> Column:
        return F.element_at(x, F.least(F.greatest(i, F.lit(1)), F.lit(size)))

    bend = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.element_at(x, i) - (neighbour(i - 1) + neighbour(i + 1)) / 2)
    rms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / size)
    sharp = F.sqrt(F.aggregate(bend, F.lit(0.0), lambda a, v: a + v * v) / size)
    return frames.select(
        *keys, F.col("frame_idx").cast("long").alias("frame_idx"), rms.alias("rms"), F.array_max(F.transform(x, F.abs)).alias("peak"),
        F.greatest(F.lit(floor), 20 * F.log10(rms + 1e-12)).alias("db"), (20 * F.log10(sharp + 1e-12)).alias("sharpness_db"),
    )
