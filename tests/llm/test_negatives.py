"""Hard negatives against sorting all scores."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cadenza.llm import negatives
from cadenza.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, k=10, positives=5, relabel=7):
    fit = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((i, (label + 1) % 10 if i % relabel == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for i, label, q in fit:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    out = []
    for a, (own, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, label) for i, label, p in fit if i != a)
        for s, pos, _ in [x for x in scored if x[2] == own][:positives]:
            fits = [(-n, i) for n, i, label in scored if label != own and -30 * s <= -100 * n <= -90 * s][:k]
            out += [(a, pos, r + 1, i, -s, n) for r, (n, i) in enumerate(fits)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, width=8, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (10, width))
    labels = rng.integers(0, 10, n)
    x = centres[labels] * 0.5 + rng.normal(0, spread, (n, width))
    return [(i, x[i].astype(np.float32).tolist(), int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("block, few", [(4096, 64), (3, 0)])
def test_all_scores(spark, monkeypatch, block, few):
    monkeypatch.setattr(negatives, "FEW", few)  # 0: refined to the last digit
    rows = vectors(1, 400)
    got = found(hard_negatives(spark.createDataFrame(rows, SCHEMA), every=40, block=block))
    assert got == plain(rows, every=40) and got


def test_hot_group_of_equal_vectors(spark):
    rows = vectors(2, 300)
    same = rows[0][1]
    rows += [(1000 + i, same, i % 3) for i in range(400)] + [(1000, same, 0)]  # ties over a third of the rows, a repeated row
    got = found(hard_negatives(spark.createDataFrame(rows, SCHEMA), every=50))
    assert got == plain(rows, every=50)


def test_awkward_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(hard_negatives(empty)) == []
    rows = vectors(3, 120) + [
        (None, [1.0] * 8, 1), (200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1), (204, [1.0] * 8, None),
        (205, [], 1), (206, [2.0, 1.0], 2), (300, [1.0] * 12, 3),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = found(hard_negatives(docs.selectExpr("*", "vec_id as id", "label as score", "1 as window"), every=20))
    assert got == plain([(i, v if v is None else [*v, *[0.0] * (12 - len(v))], c) for i, v, c in rows], every=20)
    one = spark.createDataFrame([(0, [1.0], 1), (100, [-1.0], 2)], SCHEMA)
    assert found(hard_negatives(one)) == []


def test_negative_positives_open_no_window(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (3, [0.0, 0.0], 1), (4, [0.0, 1.0], 2)]
    got = found(hard_negatives(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) == [(100, 3, 1, 4, 0, 0)]


def test_scores_beyond_range(spark):
    rows = [(100, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [1e20, 0.0], 2)]
    assert [r[:4] for r in found(hard_negatives(spark.createDataFrame(rows, SCHEMA)))] == []
