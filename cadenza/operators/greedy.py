"""Greedy, order-dependent plans: next-fit parts, chunk plans, non-overlapping picks, refractory events, keyframes.

Each is a small rule over one series in order, with its state handed from batch to batch; series are spread by Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sequential import stepwise


def next_fit_parts(df: DataFrame, key: str, order: list[str], size: str, most_size: float, most_items: int) -> DataFrame:
    """part: items in order fill a part until the next one would exceed its size or count; one too large stands alone."""

    def step(row: tuple, state: tuple) -> tuple:
        (x,), (part, total, items) = row, state
        if items and (total + x > most_size or items >= most_items):
            part, total, items = part + 1, 0.0, 0
        return part, (part, total + x, items + 1)

    return stepwise(df, [key], order, [size], "part", "int", step, (0, 0.0, 0))


def refractory(df: DataFrame, key: str, order: str, flag: str, rest: int) -> DataFrame:
    """event: a flagged frame counts unless a counted one came within `rest` frames before it."""

    def step(row: tuple, last) -> tuple:
        at, hit = row
        counted = bool(hit) and (last is None or at - last > rest)
        return counted, at if counted else last

    return stepwise(df, [key], [order], [order, flag], "event", "boolean", step, None)


def pick_apart(df: DataFrame, key: str, score: str, tie: str, start: str, length: float, most: int) -> DataFrame:
    """picked: by descending score, windows [start, start + length) that overlap none picked before, at most `most`."""

    def step(row: tuple, chosen: tuple) -> tuple:
        (at,) = row
        picked = len(chosen) < most and all(abs(at - c) >= length for c in chosen)
        return picked, (*chosen, at) if picked else chosen

    return stepwise(df, [key], [F.desc(score), F.col(tie)], [start], "picked", "boolean", step, ())


def keyframes(df: DataFrame, key: str, order: str, value: str, least: float) -> DataFrame:
    """emitted: the first value, and each that differs by `least` from the one emitted last."""

    def step(row: tuple, last) -> tuple:
        (x,) = row
        emit = last is None or abs(x - last) >= least
        return emit, x if emit else last

    return stepwise(df, [key], [order], [value], "emitted", "boolean", step, None)


def plan_chunks(pauses: DataFrame, key: str, start: str, end: str, total: str, target: float, slack: float) -> DataFrame:
    """key, chunk, chunk_start, chunk_end: cuts every `target`, moved to the middle of the longest pause within `slack`."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        length, at, cuts = float(g[total].iloc[0]), 0.0, [0.0]
        middles = sorted(((b - a, (a + b) / 2) for a, b in zip(g[start], g[end]) if a == a and b > a), key=lambda m: (-m[0], m[1]))
        while length - at > target + slack:
            ideal = at + target
            near = [m for _, m in middles if abs(m - ideal) <= slack and m > at]
            at = near[0] if near else ideal
            cuts.append(at)
        ends = [*cuts[1:], length]
        return pd.DataFrame({key: g[key].iloc[0], "chunk": range(len(cuts)), "chunk_start": cuts, "chunk_end": ends})

    kind = dict(pauses.dtypes)[key]
    return pauses.groupBy(key).applyInPandas(one, f"{key} {kind}, chunk int, chunk_start double, chunk_end double")
