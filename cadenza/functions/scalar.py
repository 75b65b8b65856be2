"""Column helpers: guarded arithmetic on levels. Null in, null out; NaN and infinities count as not finite."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x worked out once, however often f names it: expressions stay as long as they are written."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x within [low, high]; null for null and for NaN, which `greatest` would take for the largest."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(low, F.least(high, x)))


def unit(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def to_db(x: Column, floor: float = -120.0) -> Column:
    return F.when(x.isNull(), None).when(x <= 0, floor).otherwise(20 * F.log10(F.when(x > 0, x)))


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def power_mean_db(db: Column) -> Column:
    """Aggregate: 10 log10 of the mean power."""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), db / 10)) + 1e-30)


def ordered_sum(x: Column) -> Column:
    """Aggregate: the sum from the smallest up with what each step's rounding lost added at the end, the same to the last
    bit however rows are dealt, and as near to the exact sum as a double comes (but for lost bits lost again); for small groups."""

    def step(acc: Column, v: Column) -> Column:
        total = acc["total"] + v
        lost = F.when(F.abs(acc["total"]) >= F.abs(v), (acc["total"] - total) + v).otherwise((v - total) + acc["total"])
        return F.struct(total.alias("total"), (acc["lost"] + lost).alias("lost"))

    whole = lambda acc: F.when(F.abs(acc["total"]) == float("inf"), acc["total"]).otherwise(acc["total"] + acc["lost"])
    return F.aggregate(F.sort_array(F.collect_list(x)), F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost")), step, whole)


def smooth_ramp(x: Column, start: float, full: float) -> Column:
    """3t^2 - 2t^3 of how far x is from start to full."""
    t = unit((x - start) / (full - start))
    return t * t * (3 - 2 * t)


def half_up(x: Column) -> Column:
    """Round with halves toward plus infinity, unlike Spark's `round`."""
    return F.floor(x + 0.5)


def soft_limit_negative(gain: Column, limit: float) -> Column:
    return F.when(gain < 0, -limit * F.tanh(-gain / limit)).otherwise(gain)


def soft_plus(x: Column, knee: float) -> Column:
    z = x / knee
    return F.when(x.isNull(), None).when(z > 40, x).when(z < -40, 0.0).otherwise(knee * F.log1p(F.exp(F.least(z, F.lit(40.0)))))


def all_present(value: Column, *evidence: Column, default: float = 0.0) -> Column:
    """value where no evidence is missing, else default: `least` and `greatest` skip nulls and would hide it."""
    present = F.lit(True)
    for e in evidence:
        present = present & e.isNotNull()
    return F.when(present, value).otherwise(default)


def overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end1, end2) - F.greatest(start1, start2))


def null_aware_mean(*pairs: tuple[Column, float]) -> Column:
    """Weighted mean over the values that are there, weights renormalised; null if none is."""
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in pairs), F.lit(0.0))
    value = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in pairs), F.lit(0.0))
    return F.when(total > 0, value / total)


def with_facts(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """df with the other columns of facts (one row for each key); null keys are equal to each other."""
    named = facts.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    return df.join(named, on, how).drop(*(f"__key_{k}" for k in keys))
