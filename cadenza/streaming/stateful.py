"""Keyed stateful operators as Structured Streaming, each with the batch operator it agrees with.

Times are event times; watermarks bound the state. TIMESTAMP_NTZ columns are cast, since watermarks reject them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.masks import Hysteresis


def timed(events: DataFrame, at: str, late: str) -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def fixed_windows(events: DataFrame, owner: str, at: str, window: str, most: int, late: str = "1 hour") -> DataFrame:
    """Calls by owner and fixed window, and how many a limit refuses: the stream twin of a grouped count."""
    counted = timed(events, at, late).groupBy(owner, F.window(at, window).alias("w")).agg(F.count("*").alias("calls"))
    return counted.select(owner, F.col("w.start").alias("window_start"), "calls", F.greatest(F.lit(0).cast("long"), F.col("calls") - most).alias("refused"))


def first_requests(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """One row for each key within the watermark: a repeated request has no further effect."""
    return timed(events, at, late).dropDuplicatesWithinWatermark(keys)


def leases(events: DataFrame, job: str, at: str, ttl_seconds: float) -> DataFrame:
    """job, at, state for each heartbeat: `leased` at first and after an expiry, else `renewed`.

    A lease expires when the next heartbeat comes more than the time to live after the last.
    """
    kind = dict(events.dtypes)[job]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for t in sorted(t for b in batches for t in b[at]):
            now = t.timestamp()
            rows.append((key[0], t, "renewed" if last is not None and now - last <= ttl_seconds else "leased"))
            last = now if last is None else max(last, now)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=[job, at, "state"])

    slim = events.select(job, F.col(at).cast("timestamp").alias(at))
    return slim.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, {at} timestamp, state string", "last double", "append", GroupStateTimeout.NoTimeout)


def gate(frames: DataFrame, key: str, order: str, level: str, floor: float, h: Hysteresis = Hysteresis()) -> DataFrame:
    """key, order, active: a hysteresis gate over frames that arrive in order, one state a series.

    Without look-ahead and smoothing, which a stream cannot have before the frames arrive: it opens at the opening
    level, and the hold runs out below the closing level.
    """
    kinds = dict(frames.dtypes)
    opens, closes = min(max(floor + h.open_lift, h.open_range[0]), h.open_range[1]), min(max(floor + h.close_lift, h.close_range[0]), h.close_range[1])

    def run(key_values, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hold = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in rows[level]:
            hold = h.hold if x >= opens else hold if hold >= 0 and x >= closes else hold - 1 if hold >= 0 else -1
            out.append(hold >= 0)
        state.update((hold,))
        yield pd.DataFrame({key: key_values[0], order: rows[order], "active": out})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, active boolean"
    return frames.select(key, order, level).groupBy(key).applyInPandasWithState(run, schema, "hold int", "append", GroupStateTimeout.NoTimeout)
