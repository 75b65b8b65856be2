"""Evidence of consonants at a signal's own rate: frames over chunks that cut them anywhere, bodies around them, their caps.

A frame's bounds follow from absolute time, so a rate that no frame length divides does not drift. Chunks give sums and
peaks of the frames they touch, which meet by key: results do not depend on how the signal is cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc

C = F.col
#: Frame and window (ms), the least level of a body, the share of levels under a crest and the rank among
#: them, weights of a cap's neighbours and the power of their support, the share of a cap that bridges to neighbours.
FRAME_MS, WINDOW_MS, LEAST_BODY, UNDER, RANK, WEIGHTS, POWER, BRIDGE = 2.0, 280.0, -58.0, 0.72, 0.6, (1, 2, 3, 2, 1), 4, 0.4


def refusals(chunks: DataFrame, keys: list[str], total: Column | int, start: str = "start", samples: str = "samples", own_start: str | None = None, own_end: str | None = None) -> DataFrame:
    """keys, start, refusal: chunks whose own samples do not follow on each other from 0 to `total`.

    `bounds`: own samples outside the chunk; `overlap` and `gap`: against the chunk before; `beyond`: past the total;
    `short`: the last ends before it. A chunk without null samples or start is expected; null gives `bounds`.
    """
    total = total if isinstance(total, Column) else F.lit(total)
    stop = C(start) + F.size(samples)
    a, b = C(own_start) if own_start else C(start), C(own_end) if own_end else stop
    d = chunks.withColumns({"__a": a, "__b": b, "__ok": F.coalesce((a >= C(start)) & (b >= a) & (b <= stop), F.lit(False))})
    w = Window.partitionBy(*keys).orderBy("__a", "__b")
    d = d.withColumns({"__last": F.coalesce(F.lag("__b").over(w), F.lit(0)), "__next": F.lead("__a").over(w)})
    found = F.when(~C("__ok"), "bounds").when(C("__a") < C("__last"), "overlap").when(C("__a") > C("__last"), "gap").when(C("__b") > total, "beyond").when(C("__next").isNull() & (C("__b") < total), "short")
    return d.select(*keys, C(start).alias("start"), found.alias("refusal")).where("refusal IS NOT NULL")


def native_frames(chunks: DataFrame, keys: list[str], rate: float, frame_ms: float = FRAME_MS, start: str = "start", samples: str = "samples", own_start: str | None = None, own_end: str | None = None) -> DataFrame:
    """keys, frame_idx, samples, rms_db, peak_db of frames of `frame_ms` from chunks at sample `start` (from 0).

    With own_start and own_end, only those of a chunk's samples count (the rest is context). The last frame may be
    shorter; silence is -120 dB; an empty chunk gives nothing; a null sample counts as silence.
    """
    step = rate * frame_ms / 1000
    if not step >= 1:
        raise ValueError("a frame must span a sample at least")
    a, b = C(own_start) if own_start else C(start), C(own_end) if own_end else C(start) + F.size(samples)
    frame = lambda i: F.ceil((i + 0.5) / step) - 1
    bound = lambda k: sc.half_up(k * step)
    d = chunks.select(*keys, C(start).alias("__s"), C(samples).alias("__x"), a.alias("__a"), b.alias("__b")).where("__b > __a")
    d = d.withColumn("__k", F.explode(F.sequence(frame(C("__a")), frame(C("__b") - 1))))
    low, high = F.greatest(C("__a"), bound(C("__k"))), F.least(C("__b"), bound(C("__k") + 1))
    part = F.slice("__x", (low - C("__s") + 1).cast("int"), (high - low).cast("int"))
    d = d.select(*keys, C("__k").cast("long").alias("frame_idx"), F.transform(part, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("__x"))
    square, peak = (F.aggregate("__x", F.lit(0.0), f) for f in (lambda s, v: s + v * v, lambda s, v: F.greatest(s, F.abs(v))))
    d = d.select(*keys, "frame_idx", square.alias("__square"), peak.alias("__peak"), F.size("__x").alias("__many"))
    d = d.groupBy(*keys, "frame_idx").agg(F.sum("__many").alias("samples"), F.sum("__square").alias("__square"), F.max("__peak").alias("__peak"))
    return d.select(*keys, "frame_idx", "samples", sc.to_db(F.sqrt(C("__square") / C("samples"))).alias("rms_db"), sc.to_db(C("__peak")).alias("peak_db"))


def local_body(db: str, keys: list[str], reach: int) -> Column:
    """The level of what surrounds a frame by `reach` frames, crests left out; its own where all is under -58 dB."""
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-reach, reach)
    levels = F.sort_array(F.collect_list(F.when(sc.is_finite(C(db)) & (C(db) >= LEAST_BODY), C(db))).over(w))
    under = F.greatest(F.lit(1), F.ceil(F.size(levels) * UNDER))
    return F.coalesce(F.get(levels, F.floor(under * RANK).cast("int")), C(db), F.lit(-120.0))


def relax_caps(frames: DataFrame, keys: list[str], cap: str, asked: str | None = None, out: str = "cap") -> DataFrame:
    """frames with `out`: caps lowered where they stand alone, the more the fewer neighbours support them.

    Frames without a positive cap get 0, the two at each end keep theirs, and so do series of under five frames. A frame
    between two that ask for a cap (`asked`, else the cap itself) without asking is held to a share of theirs.
    """
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    many, at = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(w)
    positive = lambda x: F.when(sc.is_finite(x) & (x > 0), x)
    beside = lambda x, k: F.lag(x, -k).over(w)
    support = sum((F.coalesce(beside(positive(C(cap)), k - 2), F.lit(0.0)) * v for k, v in enumerate(WEIGHTS)), F.lit(0.0))
    own = positive(C(cap))
    held = F.coalesce(own * F.pow(sc.unit(support / (sum(WEIGHTS) * own)), POWER), F.lit(0.0))
    d = frames.withColumn("__held", F.when((at > 2) & (at <= many - 2), F.least(held, own)).otherwise(C(cap)))
    wants = F.coalesce(positive(C(asked or cap)).isNotNull(), F.lit(False))
    d = d.withColumn("__wants", wants)
    bridge = ~C("__wants") & beside(C("__wants"), -1) & beside(C("__wants"), 1)
    near = F.least(beside(C("__held"), -1), beside(C("__held"), 1)) * BRIDGE
    fixed = F.when(F.coalesce(bridge, F.lit(False)), F.least(C("__held"), near)).otherwise(C("__held"))
    return d.withColumn(out, F.when(many >= 5, fixed).otherwise(C(cap))).drop("__held", "__wants")


def window_frames(frame_ms: float = FRAME_MS) -> int:
    """The reach of `local_body` to each side."""
    return max(1, math.floor(WINDOW_MS / frame_ms + 0.5))
