from __future__ import annotations

import math

import numpy as np

from cadenza.llm import topk
from cadenza.llm.topk import top_inner_products

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    points = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in points:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in points if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def check(spark, rows, k=5, every=10, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in top_inner_products(df, k, every, **more).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, k, every)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 12))
    v = [(centres[i % 6] + 0.2 * rng.standard_normal(12)).tolist() for i in range(700)]
    check(spark, list(enumerate(v)))
    check(spark, list(enumerate(v)), sample=40, batch=64, block=16)


def test_ties_and_copies(spark):
    v = [[1.0, 0.0]] * 90 + [[0.5, 0.5]] * 3 + [[-1.0, 2.0], [0.0, 0.0], []]
    check(spark, list(enumerate(v)))


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [3.0, -1.0]), (20, [0.1])]
    check(spark, rows)
    assert top_inner_products(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(0, [1.0])])


def pairs_brute(rows, k, every):
    """As the SQL: the k best of all pairs of a row of the query's id and a row of another id."""
    points = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    out = []
    for i in sorted({i for i, _ in points if i % every == 0}):
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for me, q in points if me == i for j, v in points if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_repeated_ids(spark):
    rng = np.random.default_rng(8)
    vector = lambda scale=1.0: (scale * rng.standard_normal(6)).tolist()
    rows = [(i, vector()) for i in range(1, 150) if i % 10]
    for i, times in ((10, 2), (20, 10), (7, 9)):  # repeated rows, all among the best
        rows += [(i, [4.0] * 6)] * times
    for i, many in ((30, 2), (40, 10), (41, 12)):  # an id with several vectors
        rows += [(i, [5.0 + x] + [4.0] * 5) for x in range(many)]
    rows += [(40, [5.0] + [4.0] * 5)] * 3 + [(50, vector()), (60, [4.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for more in ({}, {"sample": 20, "batch": 32, "block": 4}):
        assert sorted(tuple(r) for r in top_inner_products(df, 5, 10, **more).collect()) == pairs_brute(rows, 5, 10)


def test_products_beyond_64_bits_are_held_at_the_ends():
    big = np.array([[2**62, 2**62], [-(2**62), -(2**62)], [3, 4]])
    ends = np.iinfo(np.int64)
    assert topk.products(big, big).tolist() == [[ends.max, ends.min, ends.max], [ends.min, ends.max, ends.min], [ends.max, ends.min, 25]]
