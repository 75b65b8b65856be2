"""Long series in blocks of frames, so that no task sorts or holds a series whole.

Frames have an index from 0 without gaps. A rule that looks a bounded number of frames around is a window over a block and
as many frames beside it (`beside_blocks`); what a whole series decides is worked out from one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.scalar import with_facts
from cadenza.sources.tables import kept

C = F.col
#: Frames of a block.
SIZE = 1 << 14


def beside_blocks(df: DataFrame, reach: int, order: str = "frame_idx", size: int = SIZE) -> DataFrame:
    """Each frame in its block (`__block`, with `__home` true) and in every other block within `reach` frames of it."""
    at = F.floor(C(order) / size)
    every = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((C(order) - reach) / size)), F.floor((C(order) + reach) / size))
    return df.withColumn("__block", F.explode(every)).withColumn("__home", C("__block") == at)


def of_blocks(df: DataFrame) -> DataFrame:
    """Each frame once again."""
    return df.where("__home").drop("__home", "__block")


def worked_out(df: DataFrame, keys: list[str], run: str, reach: int, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], reads: list[str], made: dict[str, str], order: str = "frame_idx") -> DataFrame:
    """df with `__block` and the columns `made` ({name: double or int}), which `work` gives for the frames of a run in NumPy.

    It gets a run's part of a block with `reach` frames beside it, in order: the columns it reads as doubles (NaN for null)
    and `home`, true for the block's own frames. NaN is null again.
    """
    d = beside_blocks(df, reach, order)
    schema = T.StructType([f for f in d.schema.fields if f.name != "__home"] + [T.StructField(n, T.DoubleType() if t == "double" else T.IntegerType()) for n, t in made.items()])

    def of_block(table: pa.Table) -> pa.Table:
        table = table.sort_by([(run, "ascending"), (order, "ascending")]).combine_chunks()
        runs = table[run].to_numpy()
        edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)]
        home = table["__home"].to_numpy()
        read = {n: table[n].cast(pa.float64()).to_numpy() for n in reads}
        parts = [work({n: x[a:b] for n, x in read.items()} | {"home": home[a:b]}) for a, b in zip(edges, edges[1:])]
        for n, t in made.items():
            x = np.concatenate([part[n] for part in parts])
            table = table.append_column(n, pa.array(x, pa.float64(), from_pandas=True) if t == "double" else pa.array(x, pa.int32()))
        return table.filter(table["__home"]).drop_columns(["__home"])

    return d.groupBy(*keys, "__block").applyInArrow(of_block, schema)


def indexed(df: DataFrame, keys: list[str], order: list[str], out: str = "frame_idx") -> DataFrame:
    """As frames.indexed, for long series: rows are dealt by ranges of their order and counted by range.

    Ranges follow a sample, so the dealt rows are kept: every later step sees the same ones.
    """
    d = kept(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    many = d.groupBy(*keys, "__part").agg(F.count("*").alias("__many"))
    so_far = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    many = many.withColumn("__before", F.sum("__many").over(so_far) - C("__many")).drop("__many")
    here = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)) - 1
    return with_facts(d.withColumn("__here", here), many, [*keys, "__part"]).withColumn(out, (C("__before") + C("__here")).cast("long")).drop("__part", "__here", "__before")


def with_run_id(df: DataFrame, keys: list[str], flag: str, order: str = "frame_idx", out: str = "run_id", size: int = SIZE) -> DataFrame:
    """As runs.with_run_id, for long series: runs are numbered within blocks, the blocks by their ends."""
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    change = lambda first, before, here: F.when(first | before.isNull() | (before == here), 0).otherwise(1)
    d = df.withColumn("__block", F.floor(C(order) / size))
    d = d.withColumn("__change", change(F.row_number().over(w) == 1, F.lag(flag).over(w), C(flag)))
    d = d.withColumn("__local", F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")
    ends = d.groupBy(*keys, "__block").agg(F.max("__local").alias("__many"), F.min_by(flag, order).alias("__first"), F.max_by(flag, order).alias("__last"))
    b = Window.partitionBy(*keys).orderBy("__block")
    so_far = b.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("__edge", change(F.row_number().over(b) == 1, F.lag("__last").over(b), C("__first")))
    ends = ends.withColumn("__base", F.sum(C("__edge") + C("__many")).over(so_far) - C("__many")).select(*keys, "__block", "__base")
    return with_facts(d, ends, [*keys, "__block"]).withColumn(out, C("__base") + C("__local")).drop("__block", "__base", "__local")


def finalize_mask(df: DataFrame, keys: list[str], flag: str, least: int, most_gap: int, frames: str, order: str = "frame_idx", size: int = SIZE) -> DataFrame:
    """As runs.finalize_mask, for long series; `frames` is the column with a series' number of frames.

    Whether a run is short shows within a few frames of each of its frames.
    """
    near = max(least, most_gap + 1)
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    d = beside_blocks(df, 2 * near + 4, order, size)

    def sized(d: DataFrame) -> DataFrame:
        """With where a frame's run starts and ends, null where that is farther than `near`."""
        before = F.lag(flag).over(w)
        d = d.withColumn("__starts", (C(order) == 0) | ~F.when(before.isNull() | (before == C(flag)), True).otherwise(False))
        d = d.withColumn("__ends", (C(order) == C(frames) - 1) | F.coalesce(F.lead("__starts").over(w), F.lit(False)))
        start = F.max(F.when(C("__starts"), C(order))).over(w.rowsBetween(-near, 0))
        end = F.min(F.when(C("__ends"), C(order))).over(w.rowsBetween(0, near))
        return d.withColumn("__start", start).withColumn("__end", end)

    length = F.coalesce(C("__end") - C("__start") + 1, F.lit(near + 1))
    d = sized(d).withColumn(flag, C(flag) & (length >= least))
    inner = (C("__start") > 0) & (C("__end") < C(frames) - 1) & (length <= most_gap)
    d = sized(d).withColumn(flag, C(flag) | F.coalesce(inner, F.lit(False)))
    return of_blocks(d.drop("__starts", "__ends", "__start", "__end"))


def last_known(df: DataFrame, keys: list[str], values: dict[str, Column], order: str = "frame_idx", size: int = SIZE) -> DataFrame:
    """df with {out: value}: the last that is not null up to a frame, in series of any length; df is read twice."""
    d = df.withColumn("__block", F.floor(C(order) / size)).withColumns(values)
    ends = d.groupBy(*keys, "__block").agg(*(F.max_by(o, F.when(C(o).isNotNull(), C(order))).alias(f"__end_{o}") for o in values))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"__end_{o}": F.last(f"__end_{o}", ignorenulls=True).over(earlier) for o in values})
    w = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = with_facts(d.withColumns({o: F.last(o, ignorenulls=True).over(w) for o in values}), ends, [*keys, "__block"])
    return d.withColumns({o: F.coalesce(C(o), C(f"__end_{o}")) for o in values}).drop("__block", *(f"__end_{o}" for o in values))
