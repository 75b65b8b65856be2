"""Pairing, comparison and alignment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_one_to_one(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """Full outer pairing on key that keeps 1:1 keys as pairs and says why others stay unmatched."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"), F.min(left_id).alias("left_id"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"), F.min(right_id).alias("right_id"))
    both = a.join(b, key, "full_outer").fillna(0, ["n_left", "n_right"])
    one = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    status = F.when(one, "paired").when(F.col("n_left") == 0, "no_source").when(F.col("n_right") == 0, "no_result").otherwise("ambiguous")
    return both.select(key, "n_left", "n_right", F.when(one, F.col("left_id")).alias("left_id"), F.when(one, F.col("right_id")).alias("right_id"), status.alias("status"))


def before_after(df: DataFrame, key: str, role: Column, order: list[Column], metrics: list[str]) -> DataFrame:
    """Per key the least row of role 'before' and of 'after' by order, and the metrics' deltas; keys with both only."""
    packed = F.struct(*order, *(F.col(m).alias(f"__{m}") for m in metrics))
    picked = df.groupBy(key).agg(*(F.min(F.when(role == r, packed)).alias(r) for r in ("before", "after")))
    picked = picked.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    cols = []
    for m in metrics:
        b, a = F.col(f"before.__{m}"), F.col(f"after.__{m}")
        cols += [b.alias(f"{m}_before"), a.alias(f"{m}_after"), (a - b).alias(f"{m}_delta")]
    return picked.select(key, *cols)


def lagged_pairs(left: DataFrame, right: DataFrame, keys: list[str], lags: range, order: str = "frame_idx", taken: Column | None = None) -> DataFrame:
    """left joined to right shifted by each lag: right frame = left frame + lag. The lag list is a literal.

    `taken`, of left's columns and lag, says which pairs are wanted; the others are not made, nor shuffled.
    """
    shifted = left.select("*", F.explode(F.array(*(F.lit(k).cast("long") for k in lags))).alias("lag"))
    if taken is not None:
        shifted = shifted.where(taken)
    return shifted.withColumn("__at", F.col(order) + F.col("lag")).join(right.withColumnRenamed(order, "__at"), [*keys, "__at"]).drop("__at")


def lag_correlation(df: DataFrame, keys: list[str], x: str, lags: range, order: str = "frame_idx") -> DataFrame:
    """Cosine autocorrelation of x at each lag: keys, lag, pairs, correlation. Lags are window leads, not a self join."""
    w = Window.partitionBy(*keys).orderBy(order)
    wide = df.select(*keys, F.col(x).alias("__x"), *(F.lead(x, k).over(w).alias(f"__l{k}") for k in lags))
    long = wide.select(*keys, "__x", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"__l{k}").alias("y")) for k in lags))).alias("__p")).where("__p.y is not null")
    a, b = F.col("__x"), F.col("__p.y")
    energy = F.sqrt(F.sum(a * a) * F.sum(b * b))
    return long.groupBy(*keys, F.col("__p.lag").alias("lag")).agg(F.count("*").alias("pairs"), F.when(energy > 0, F.sum(a * b) / energy).otherwise(0.0).alias("correlation"))


def best_lag(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The lag of the highest score, of equal ones the nearest to 0, and how far the next best is behind."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.abs("lag"), "lag")
    ranked = scores.withColumn("__n", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w)).where("__n = 1")
    return ranked.select(*keys, "lag", F.col(score).alias("best"), (F.col(score) - F.coalesce("__next", F.lit(0.0))).alias("margin"))


def nearest_match(left: DataFrame, right: DataFrame, keys: list[str], t: str, tolerance: float, right_value: str) -> DataFrame:
    """left with right's value at the nearest t within the tolerance; null if two are as near, or none is.

    The range is turned into equal buckets of the tolerance, of which each left row looks into three.
    """
    cell = F.floor(F.col(t) / tolerance).cast("long")
    a = left.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in left.columns else left
    cells = a.select(*keys, "__row", F.col(t).alias("__t"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    b = right.select(*keys, cell.alias("__cell"), F.col(t).alias("__u"), F.col(right_value).alias("__v"))
    away = F.abs(F.col("__t") - F.col("__u"))
    near = cells.join(b, [*keys, "__cell"]).where(away <= tolerance).select("__row", away.alias("__away"), "__v")
    least = near.groupBy("__row").agg(F.min(F.struct("__away", "__v")).alias("__hit"), F.min("__away").alias("__least"))
    ties = near.join(least, "__row").where(F.col("__away") == F.col("__least")).groupBy("__row").agg(F.count("*").alias("__ties"), F.first("__hit").alias("__hit"))
    out = a.join(ties, "__row", "left")
    return out.select(*left.columns, F.when(F.col("__ties") == 1, F.col("__hit.__v")).alias(f"matched_{right_value}"), F.when(F.col("__ties") == 1, F.col("__hit.__away")).alias("distance"))
