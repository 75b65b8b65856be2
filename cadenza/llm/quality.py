"""Quality scores of documents: Bradley-Terry ranking from preference pairs.

Each labelled good document is preferred to each labelled bad one. The strength of a document is linear in features
of its whole text, learned by logistic loss on the feature differences of sampled pairs. The threshold is a quantile of
the strengths of labelled documents that the fit did not see (one in four of the sample): the one that parts the classes
best, taken a quarter of the way from the strength under it to the one over it. Strengths map to scores so that the
threshold scores `cut`. Only the fit is on a bounded sample (`sample` labelled rows, `pairs` pairs); every document is
scored on its whole text.

Null and empty texts have the features of an empty text and get a score like any other. With no labelled row of
either class there is nothing to prefer: every score is `cut`, so every document is kept. Labels that are null are
not used; a document with several labels counts with the smallest. Documents with a null doc_id are scored, never
learned from. Repeated rows are scored alike; a score equal to `cut` is accepted. An empty table gives no rows. Other
columns pass; input columns named score, held_out or predicted are replaced by quality_scores and pass in keep_good.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of ASCII bytes whose shares are features.
_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", ".,;:", "'\"()-/", "#$%&*+=@^_~\\`", "|<>[]{}", "\n")
FEATURES = len(_GROUPS) + 8


def _table() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS)))
    for k, group in enumerate(_GROUPS):
        out[list(group.encode()), k] = 1
    return out


_OF_GROUP = _table()


def features(text: str) -> np.ndarray:
    """Shares of character groups, and how varied the words, word pairs and lines are."""
    blob = text.encode("utf-8", "surrogatepass")
    words = blob.split()
    n, m = max(1, len(blob)), max(1, len(words))
    shares = np.bincount(np.frombuffer(blob, np.uint8), minlength=256) @ _OF_GROUP / n
    kinds, next_to = len(set(words)), words[1:]
    twice = sum(map(eq, words, next_to)) / m
    bigrams = len(set(zip(words, next_to))) / max(1, len(next_to)) if next_to else 1.0
    lines = blob.split(b"\n")
    more = [
        math.log1p(kinds) / math.log1p(m), min(1.0, kinds / m), bigrams, math.sqrt(twice), len(set(lines)) / len(lines),
        min(3.0, math.log1p(n / m)), min(1.0, m / 50), math.log1p(m) / 10,
    ]
    return np.concatenate((np.sqrt(shares), more))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    weights: np.ndarray  # per raw feature
    threshold: float
    scale: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = (x - self.mean) @ self.weights
        z = np.clip((strength - self.threshold) * self.scale, -30, 30) + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, good: np.ndarray, cut: float, held: tuple[np.ndarray, np.ndarray] | None = None, pairs: int = 20_000, steps: int = 400, seed: int = 7) -> Model:
    """Bradley-Terry by gradient descent on sampled pairs, then the quantile that parts the classes of held rows best."""
    width = x.shape[1] if x.ndim == 2 else FEATURES
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(better) or not len(worse):
        return Model(np.zeros(width), np.zeros(width), 0.0, 1.0, cut)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    w, speed = np.zeros(width), np.zeros(width)
    for _ in range(steps):
        slope = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(axis=0) + 1e-3 * w
        speed = 0.9 * speed - 0.3 * slope
        w = w + speed
    seen, strength = (good, z @ w) if held is None else (held[1], ((held[0] - mean) / spread) @ w)
    return Model(mean, w / spread, float(np.quantile(strength, parting(strength, seen))), 3 / (float(strength.std()) + 1e-9), cut)


def parting(strength: np.ndarray, good: np.ndarray) -> float:
    """The level of the quantile that parts the classes best, nearer to the strength under it: a doubtful document stays."""
    order = np.argsort(strength, kind="stable")
    ok, n = good[order], len(order)
    below = np.cumsum(~ok) / max(1, (~ok).sum()) - np.cumsum(ok) / max(1, ok.sum())  # of the first k + 1 rejected
    below[:-1][strength[order][1:] == strength[order][:-1]] = -1  # equal strengths stay together
    k = int(below.argmax())
    return min(1.0, (k + 0.25) / max(1, n - 1))


def learnable(doc_id: Column) -> Column:
    """Whether labels of this doc_id may be learned from: one in five is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = 6_000) -> Model:
    """A model from at most `sample` labelled rows, which a hash of the doc_id picks."""
    usable = labels.where(learnable(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("array<double>")
    def feature_rows(text: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in text])

    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = known.select("doc_id", "quality", feature_rows("text").alias("x")).collect()  # at most `sample` rows
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], dtype=float)
    good = np.array([r["quality"] >= 1 for r in rows], dtype=bool)
    apart = np.arange(len(rows)) % 4 == 3
    if all(len(set(good[part])) == 2 for part in (apart, ~apart)):
        return fit(x[~apart], good[~apart], cut, (x[apart], good[apart]))
    return fit(x, good, cut)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in text]).reshape(len(text), FEATURES)  # one text at a time; the rows are short
        return pd.Series(model.scores(x))

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted (1 where score >= cut)."""
    scored = docs.withColumn("score", score_column(train(docs, labels, cut), F.col("text")))
    return scored.withColumn("held_out", ~learnable(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least cut, with their own columns."""
    return docs.where(score_column(train(docs, labels, cut), F.col("text")) >= cut)
