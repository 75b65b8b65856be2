"""Cutting a timeline into render segments: cuts moved into silences, pads by what lies at the cuts, merging by risk.

Cuts depend on the cut before them, so silences are walked in order with the last cut as state; what is held are the
silences that can still matter to the next cut. All else is windows and a bucketed interval join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.operators import intervals, sequential

#: Lengths in seconds, pads in milliseconds, and the share of speech from which a segment is processed.
TARGET, MOST, EARLIEST, LEAST_SILENCE, LONG_SILENCE = 30.0, 42.0, 0.55, 0.4, 0.5
PAD_IN, PAD_IN_GUARDED, PAD_OUT, PAD_OUT_GUARDED, TAIL, TAIL_GUARDED = 160, 240, 320, 580, 140, 220
LEAST_SPEECH = 0.01
#: Cuts that wait to be handed back together.
_HELD = 1_000


class _Cuts:
    """Feeds on silences by start; a cut is settled once no later silence can reach it."""

    def __init__(self, keys: list[str], start: str, end: str, total: str, target: float, most: float):
        self.keys, self.columns, self.total, self.target, self.most = keys, (start, end), total, target, most
        self.cursor, self.number, self.spans, self.found, self.row = 0.0, 0, [], [], None

    def _settle(self, upto: float) -> list[tuple]:
        out, whole = [], float(self.length)
        while self.cursor < whole - 0.02 and min(whole, self.cursor + self.most) < upto:
            low, ideal, high = (min(whole, self.cursor + d) for d in (self.target * EARLIEST, self.target, self.most))
            middles = [(a + b) / 2 for a, b in self.spans if b - a >= LEAST_SILENCE]
            cut = min((m for m in middles if low <= m <= high), key=lambda m: abs(m - ideal), default=high)
            if cut <= self.cursor + 0.25:
                cut = ideal
            cut = max(self.cursor + 0.1, cut)
            quiet = [any(b - a >= LONG_SILENCE and a <= t <= b for a, b in self.spans) for t in (self.cursor, cut)]
            out.append((self.number, self.cursor, cut, *quiet))
            self.cursor, self.number = cut, self.number + 1
            self.spans = [s for s in self.spans if s[1] >= cut]
        return out

    def _rows(self, rest: int = 0) -> pd.DataFrame | None:
        if len(self.found) <= rest:
            return None
        out = {k: pd.Series([v] * len(self.found), dtype=object if v is None else None) for k, v in self.row.items()}
        out |= zip(("segment", "seg_start", "seg_end", "quiet_start", "quiet_end"), zip(*self.found))
        self.found = []
        return pd.DataFrame(out)

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        if self.row is None:
            self.row, self.length = {k: rows[k].iat[0] for k in self.keys}, rows[self.total].iat[0]
        if not (math.isfinite(self.length) and self.length > 0):
            return None
        for a, b in zip(*(rows[c] for c in self.columns)):
            if a == a and b == b:  # a series without silences comes as one row of nulls
                self.found += self._settle(a)
                self.spans.append((a, b))
        return self._rows(_HELD)

    def end(self) -> pd.DataFrame | None:
        if not (math.isfinite(self.length) and self.length > 0):
            return None
        self.found += self._settle(math.inf)
        return self._rows()


def cuts(silences: DataFrame, lengths: DataFrame, keys: list[str], start: str, end: str, total: str, target: float = TARGET, most: float = MOST) -> DataFrame:
    """keys, segment, seg_start, seg_end, quiet_start, quiet_end of the segments of [0, total) of each series of `lengths`.

    A cut goes to the middle of the silence (of 0.4 s at least) nearest to `target` after the last one, between 0.55 of
    that and `most`; the earlier of two as near; without one to `most`. quiet: whether the end lies in a silence of
    half a second. A length that is null, not finite or not positive gives no segments.
    """
    kinds = dict(lengths.dtypes)
    d = lengths.select(*keys, total).join(silences.select(*keys, start, end), keys, "left")
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "segment int, seg_start double, seg_end double, quiet_start boolean, quiet_end boolean"])
    return sequential.over_sorted(d, keys, [start, end], lambda: _Cuts(keys, start, end, total, target, most), schema)


def segments(silences: DataFrame, speech: DataFrame, lengths: DataFrame, keys: list[str], start: str, end: str, total: str, strict: Column | bool = False, target: float = TARGET, most: float = MOST) -> DataFrame:
    """The segments of `cuts` with occupancy (share of speech; its spans must not overlap), process, guarded, trim_in_ms and trim_out_ms.

    Segments with speech are processed. Endings are guarded where `strict` says so, in long silences, and at the last
    processed segment. Pads are null-free: 0 where nothing is processed.
    """
    found = cuts(silences, lengths, keys, start, end, total, target, most)
    spans = speech.select(*keys, F.col(start).alias("s_start"), F.col(end).alias("s_end"))
    share = intervals.occupancy(found.select(*keys, "segment", F.col("seg_start").alias("w_start"), F.col("seg_end").alias("w_end")), spans, keys, "segment", most)
    d = found.join(share.select(*keys, "segment", "occupancy"), [*keys, "segment"], "left").withColumn("occupancy", F.coalesce("occupancy", F.lit(0.0)))
    d = d.withColumn("process", F.col("occupancy") >= LEAST_SPEECH)
    last = F.max(F.when(F.col("process"), F.col("segment"))).over(Window.partitionBy(*keys))
    strict = strict if isinstance(strict, Column) else F.lit(bool(strict))
    guarded = F.col("process") & (strict | F.col("quiet_end") | (F.col("segment") == last))
    d = d.withColumn("guarded", F.coalesce(guarded, F.lit(False)))
    into = F.when(~F.col("process") | F.col("quiet_start"), 0).when(F.col("guarded"), PAD_IN_GUARDED).otherwise(PAD_IN)
    out = F.when(~F.col("process"), 0).when(F.col("quiet_end"), F.when(F.col("guarded"), TAIL_GUARDED).otherwise(TAIL)).when(F.col("guarded"), PAD_OUT_GUARDED).otherwise(PAD_OUT)
    return d.withColumn("trim_in_ms", into).withColumn("trim_out_ms", out)


def merge_for_risk(found: DataFrame, keys: list[str], longest_pause: float, most_processed: int) -> DataFrame:
    """Segments, of which so many unprocessed ones between two processed ones join their neighbours that at most
    `most_processed` are left, or as few as pauses up to `longest_pause` allow; the shortest first, then the earlier.

    Which of them may go does not change as others do, so ranks within a series decide for all at once.
    """
    w = Window.partitionBy(*keys)
    inside = w.orderBy("segment")
    beside = F.coalesce(F.lag("process").over(inside) & F.lead("process").over(inside), F.lit(False))
    pause = F.col("seg_end") - F.col("seg_start")
    d = found.withColumn("__free", ~F.col("process") & beside & (pause <= longest_pause)).withColumn("__over", F.sum(F.col("process").cast("int")).over(w) - most_processed)
    d = d.withColumn("__rank", F.row_number().over(w.orderBy(F.desc("__free"), pause, "segment")))
    d = d.withColumn("__gone", F.col("__free") & (F.col("__rank") <= F.col("__over")))
    joined = F.col("__gone") | F.coalesce(F.lag("__gone").over(inside), F.lit(False))
    d = d.withColumn("__group", F.sum(F.when(joined, 0).otherwise(1)).over(inside))
    first, last = (lambda c: F.min_by(c, "segment").alias(c)), (lambda c: F.max_by(c, "segment").alias(c))
    out = d.groupBy(*keys, "__group").agg(
        F.min("segment").alias("segment"), F.count("*").cast("int").alias("parts"), F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"),
        F.max("process").alias("process"), first("trim_in_ms"), last("trim_out_ms"), F.max("guarded").alias("guarded"),
    )
    return out.drop("__group")


def render_window(rate: int, total: Column, start: Column, end: Column, first: Column, history: float = 1.0, leading: float = 0.0, trailing: float = 0.0, overlap: float = 0.0, trim: float = 0.0) -> Column:
    """struct<read_start, read_end, trim_start, trim_end, output_start, output_end, error> in samples.

    All but the first segment (`first`) read what comes before them, so that filters with state are warm; that is trimmed
    off again. error names why there is no window: times that are null, not finite or negative, an empty segment, or a
    trim that leaves nothing.
    """
    at = lambda seconds: sc.half_up(seconds * rate).cast("long")
    size = {k: math.floor(v * rate + 0.5) for k, v in {"history": history, "leading": leading, "trailing": trailing, "overlap": overlap, "trim": trim}.items()}
    whole = at(total)
    a = F.least(at(start), whole)
    b = F.greatest(a, F.least(at(end), whole))
    good = F.lit(True)
    for t in (total, start, end):
        good = good & F.coalesce(sc.is_finite(t) & (t >= 0), F.lit(False))
    error = F.when(~good, "time not finite or negative").when(b <= a, "empty segment").when(b - a <= 2 * size["trim"], "trim leaves nothing")
    out_a, out_b = a + size["trim"], F.least(whole, b - size["trim"] + size["overlap"])
    near = F.greatest(F.lit(0), a - size["leading"])
    read_a = F.when(first, near).otherwise(F.least(near, F.greatest(F.lit(0), out_a - size["history"])))
    read_b = F.least(whole, b + size["trailing"] + size["overlap"])
    known = {"read_start": read_a, "read_end": read_b, "trim_start": out_a - read_a, "trim_end": out_b - read_a, "output_start": out_a, "output_end": out_b}
    return F.struct(*(F.when(error.isNull(), v).alias(k) for k, v in known.items()), error.alias("error"))
