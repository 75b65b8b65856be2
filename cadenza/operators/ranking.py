"""A linear pairwise ranker: logistic loss on feature differences, full-batch gradient descent with fixed steps.

The pairs stay distributed. A step is one aggregate of as many sums as there are features; only the weights are on
the driver. Lower scores are better, as for the rankings that use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import kept


def score(features: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    return sum((F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in zip(features, weights)), F.lit(float(intercept)))


def preference_pairs(rows: DataFrame, group: str, preferred: Column, features: list[str]) -> DataFrame:
    """group and, by feature, preferred minus other, for groups with one row of either kind; missing values count as 0."""
    value = lambda f, yes: F.sum(F.when(preferred == yes, F.coalesce(F.col(f), F.lit(0.0))))
    counts = (F.count_if(preferred).alias("__yes"), F.count_if(~preferred).alias("__no"))
    wide = rows.groupBy(group).agg(*counts, *((value(f, True) - value(f, False)).alias(f) for f in features))
    return wide.where("__yes = 1 and __no = 1").drop("__yes", "__no")


def preferred_over_others(rows: DataFrame, group: str, preferred: Column, features: list[str]) -> DataFrame:
    """By feature, preferred minus other, for each preferred row of a group and each other row of it; missing values count as 0."""
    values = rows.select(group, preferred.alias("__yes"), *(F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in features))
    best = values.where("__yes").select(group, *(F.col(f).alias(f"__{f}") for f in features))
    return best.join(values.where("not __yes"), group).select(group, *((F.col(f"__{f}") - F.col(f)).alias(f) for f in features))


def fit(pairs: DataFrame, features: list[str], rate: float = 0.08, steps: int = 240, ridge: float = 0.0015) -> list[float]:
    """Weights after `steps` of gradient descent, each shrunk by the ridge; a preferred row is to score lower."""
    pairs = kept(pairs.groupBy(*features).agg(F.count("*").alias("__n")), "pairs")  # equal differences once, with their count
    weights = [0.0] * len(features)
    for _ in range(steps):
        miss = 1 / (1 + F.exp(-score(features, weights)))  # how likely the weights have the pair the wrong way round
        slopes = pairs.agg(*((F.sum(miss * F.col(f) * F.col("__n")) / F.sum("__n")).alias(f) for f in features)).first()
        weights = [w - rate * ((slopes[f] or 0.0) + ridge * w) for w, f in zip(weights, features)]
    return weights
