"""Rules that must see a series in order, with state handed from batch to batch.

Rows are dealt by key and sorted within partitions (Spark spills what does not fit), and a task walks them in Arrow
batches: what it holds is a batch and the rule's own state, however long a series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


#: Rows that are handed back at a time.
_ROWS = 5_000


class Rule(Protocol):
    """A fresh one serves each series. Both methods may give back rows, or None."""

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None: ...

    def end(self) -> pd.DataFrame | None: ...


def key_starts(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a row's key differs from that of the row before it; nulls are equal to each other."""
    new = np.zeros(len(batch), bool)
    for k in keys:
        v = batch[k]
        was = v.shift()
        new |= ((v != was) & ~(v.isna() & was.isna())).to_numpy(bool)
    new[:1] = True
    return np.flatnonzero(new)


def gathered(frames: Iterator[pd.DataFrame], rows: int = _ROWS) -> Iterator[pd.DataFrame]:
    """The same rows in fewer frames: what short series give back is put together."""
    held, many = [], 0
    for d in frames:
        held.append(d)
        many += len(d)
        if many >= rows:
            yield pd.concat(held, ignore_index=True)
            held, many = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def over_sorted(df: DataFrame, keys: list[str], order: list[str | Column], make: Callable[[], Rule], schema: str) -> DataFrame:
    """What the rules made by `make` give back for the rows of each series in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return gathered(walked(batches))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rule = None, None
        for batch in batches:
            if not len(batch):
                continue
            starts = key_starts(batch, keys)
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                here = tuple(None if pd.isna(v) else v for v in (batch[k].iat[a] for k in keys))
                if rule is None or here != last:
                    if rule is not None and (rest := rule.end()) is not None:
                        yield rest
                    rule, last = make(), here
                if (out := rule.feed(batch.iloc[a:b])) is not None and len(out):
                    yield out
        if rule is not None and (rest := rule.end()) is not None:
            yield rest

    # a fixed number of parts: by their bytes Spark would leave the work of many short series to one task
    spark = df.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def schema_with(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


class Stepwise:
    """A rule that adds one column, row by row: step(row values, state) -> (value, state)."""

    def __init__(self, columns: list[str], out: str, step: Callable, state):
        self.columns, self.out, self.step, self.state = columns, out, step, state

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        values = []
        for row in zip(*(rows[c] for c in self.columns)):
            value, self.state = self.step(row, self.state)
            values.append(value)
        return rows.assign(**{self.out: values})

    def end(self) -> None:
        return None


def stepwise(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[str], out: str, kind: str, step: Callable, state) -> DataFrame:
    """df with one more column that a step computes from a row's columns and the state that the row before it left."""
    return over_sorted(df, keys, order, lambda: Stepwise(columns, out, step, state), schema_with(df, f"`{out}` {kind}"))
