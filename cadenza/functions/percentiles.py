"""The percentile family. The rules differ and are not interchangeable; none of them is approximate.

Whole-group aggregates (`linear`, `nearest_rank`, `lower_median`) hold a group's values at once, as Spark's own exact
percentile does; `placed` gives the same for groups of any size. Weighted ones are windows over a sorted group, which spill, so a group of any size works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import with_facts
from cadenza.sources.tables import kept


def linear(x: Column, p: float) -> Column:
    """Linear interpolation at rank p (n - 1)."""
    return F.percentile(x, F.lit(p))


def nearest_rank(x: Column, p: float) -> Column:
    """The value at rank floor(p (n - 1) + 0.5) of the sorted group."""
    values = F.sort_array(F.collect_list(x))
    return F.element_at(values, F.floor(p * (F.size(values) - 1) + 0.5).cast("int") + 1)


def lower_median(x: Column) -> Column:
    """The middle value, of two the lower one."""
    return F.element_at(F.sort_array(F.collect_list(x)), F.floor((F.count(x) + 1) / 2).cast("int"))


def ranked(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """df with nearest-rank percentiles of its groups as columns: {out: (column, p)}.

    Ranks come from windows that sort a group and spill, so no group is held as a list. Nulls do not count.
    """
    part = Window.partitionBy(*keys)
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        n = F.count(value).over(part)
        df = df.withColumn("__at", F.row_number().over(part.orderBy(F.col(value).asc_nulls_last()))).withColumn("__many", n)
        for out, p in ((o, p) for o, (v, p) in wanted.items() if v == value):
            df = df.withColumn(out, F.max(F.when(F.col("__at") == F.floor(p * (F.col("__many") - 1) + 0.5) + 1, F.col(value))).over(part))
    return df.drop("__at", "__many")


#: Of `placed`: how far around a rank an approximate percentile looks, its accuracy, and the size from which it is asked.
_BESIDE, _ACCURACY, _MANY = 0.005, 2_000, 10_000


def placed(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], nearest: bool = False, also: tuple[Column, ...] = ()) -> DataFrame:
    """keys, __n (rows), the aggregates `also`, and exact percentiles {out: (value, p)} of groups of any size: linear, or of
    the nearest rank.

    Approximate percentiles just below and above a rank leave one row in a hundred of a large group; how many are under
    them is counted, and only those between are sorted. df is read three times. Nulls do not count.
    """
    values = list(dict.fromkeys(v for v, _ in wanted.values()))
    outs = list(wanted)
    unit = lambda x: min(1.0, max(0.0, x))
    brackets = {v: [b for o in outs if wanted[o][0] == v for b in (unit(wanted[o][1] - _BESIDE), unit(wanted[o][1] + _BESIDE))] for v in values}
    facts = [F.count("*").alias("__n"), *also]
    for k, v in enumerate(values):
        odd = F.count_if(F.isnan(F.col(v).cast("double")))
        facts += [F.count(v).alias(f"__many{k}"), F.when((F.count(v) >= _MANY) & (odd == 0), F.percentile_approx(v, brackets[v], _ACCURACY)).alias(f"__q{k}")]
    facts = kept(df.groupBy(*keys).agg(*facts), "brackets")  # of known size, so that Spark broadcasts them if they are few
    shown = [c for c in facts.columns if c not in keys and not c.startswith(("__many", "__q"))]
    d = with_facts(df.select(*keys, *values), facts.drop(*shown), keys)
    under, between = [], []
    for j, o in enumerate(outs):
        v, k = wanted[o][0], values.index(wanted[o][0])
        at = 2 * [x for x in outs if wanted[x][0] == v].index(o)
        low, high = F.col(f"__q{k}")[at], F.col(f"__q{k}")[at + 1]
        under.append(F.count_if((F.col(v) < low)).alias(f"__under{j}"))
        here = F.when(low.isNull() | F.col(v).between(low, high), F.col(v).cast("double"))
        between.append(F.when(here.isNotNull(), F.struct(F.lit(j).alias("j"), here.alias("x"))))
    facts = with_facts(facts, d.groupBy(*keys).agg(*under), keys)
    inside = d.select(*keys, F.explode(F.array_compact(F.array(*between))).alias("__s")).select(*keys, "__s.j", "__s.x").groupBy(*keys, "j", "x").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    pick = lambda name: F.element_at(F.array(*(F.col(f"{name}{j}" if name == "__under" else f"__many{values.index(wanted[o][0])}") for j, o in enumerate(outs))), F.col("j") + 1)
    share = F.element_at(F.array(*(F.lit(float(wanted[o][1])) for o in outs)), F.col("j") + 1)
    inside = with_facts(inside.withColumn("__upto", upto), facts, keys).select(*keys, "j", "x", "__c", (F.col("__upto") + pick("__under")).alias("__upto"), (share * (pick("__many") - 1)).alias("__at"))
    holds = lambda rank: F.max(F.when((rank >= F.col("__upto") - F.col("__c")) & (rank < F.col("__upto")), F.col("x")))
    low, high = (F.floor(F.col("__at") + 0.5),) * 2 if nearest else (F.floor("__at"), F.ceil("__at"))
    found = inside.groupBy(*keys, "j").agg(F.max("__at").alias("__at"), holds(low).alias("a"), holds(high).alias("b"))
    mixed = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    mixed = mixed.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("__at") - F.col("__at")) * F.col("a") + (F.col("__at") - F.floor("__at")) * F.col("b"))
    found = found.withColumn("__v", mixed).groupBy(*keys).agg(*(F.max(F.when(F.col("j") == j, F.col("__v"))).alias(o) for j, o in enumerate(outs)))
    return kept(with_facts(facts.select(*keys, *shown), found, keys), "percentiles")


def _usable(df: DataFrame, value: str, weight: str) -> DataFrame:
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf"))
    return df.where(ok & (F.col(weight) > 0) & (F.col(weight) < float("inf")))


def weighted_step(df: DataFrame, keys: list[str], value: str, weight: str, p: float, out: str) -> DataFrame:
    """Per group the smallest value at which the cumulated weight reaches p of the total."""
    so_far = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    ranked = _usable(df, value, weight).select(*keys, value, F.sum(weight).over(so_far).alias("__w"), F.sum(weight).over(Window.partitionBy(*keys)).alias("__total"))
    hit = F.min(F.when(F.col("__w") >= F.col("__total") * p, F.col(value)))
    return ranked.groupBy(*keys).agg(F.coalesce(hit, F.max(value)).alias(out))


def weighted_midpoint(df: DataFrame, keys: list[str], value: str, weight: str, p: float, out: str, tie: str) -> DataFrame:
    """Per group linear interpolation through the midpoints of the weighted cumulative distribution.

    A small change of a weight gives a small change of the result. `tie` orders equal values.
    """
    order = Window.partitionBy(*keys).orderBy(value, tie)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    at = (F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight) / 2) / total
    placed = _usable(df, value, weight).select(*keys, value, tie, at.alias("__at"))
    placed = placed.withColumn("__before", F.lag(value).over(order)).withColumn("__from", F.lag("__at").over(order)).withColumn("__n", F.row_number().over(order))
    mix = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - F.col("__from")) / (F.col("__at") - F.col("__from"))))
    here = F.when(F.col("__n") == 1, F.col(value)).otherwise(F.col("__before") * (1 - mix) + F.col(value) * mix)
    first = F.min_by(here, F.when(F.col("__at") >= p, F.col("__n")))
    return placed.groupBy(*keys).agg(F.coalesce(first, F.max(value)).alias(out))


def mad_filtered_median(df: DataFrame, keys: list[str], value: str, out: str, limit: float = 2.8) -> DataFrame:
    """Per group the median of the values within `limit` scaled median absolute deviations; all if the deviation is 0."""
    part = Window.partitionBy(*keys)
    middle = df.where(F.col(value).isNotNull()).select(*keys, value, F.median(value).over(part).alias("__m"))
    spread = middle.withColumn("__d", F.abs(F.col(value) - F.col("__m"))).withColumn("__mad", F.median("__d").over(part))
    near = (F.col("__mad") == 0) | (F.col("__d") / (1.4826 * F.col("__mad")) <= limit)
    return spread.groupBy(*keys).agg(F.median(F.when(near, F.col(value))).alias(out))
