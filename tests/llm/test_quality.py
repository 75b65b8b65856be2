from __future__ import annotations

import random
import zlib

import numpy as np

from cadenza.llm import quality
from cadenza.llm.quality import FEATURES, features, fit, quality_scores


def corpus():
    rng = random.Random(2)
    words = ["the", "of", "stone", "river", "walks", "over", "morning", "light", "under", "trees", "slowly", "reading", "a", "book"]
    texts, labels = [], []
    for i in range(240):
        body = " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "er", "ing"]) for _ in range(60)) + "."
        bad = i % 4 == 0
        texts.append([body.upper() + "!!", "## ".join(body.split()), " | ".join(body.split()), "spam " * 60][i // 4 % 4] if bad else body.capitalize())
        labels.append((i, int(not bad), 0))
    return texts, labels


def test_held_out_accuracy(spark, make):
    texts, labels = corpus()
    got = quality_scores(make(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {d: q for d, q, _ in labels}
    assert len(got) == 240 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_held_out_labels_do_not_matter(spark, make):
    texts, labels = corpus()
    wrong = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality_scores(make(texts), spark.createDataFrame(x, schema)).collect()) for x in (labels, wrong))
    assert a == b


def test_awkward_rows(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, None), (4, 0, 0), (None, 1, 1), (5, None, 0), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert {round(r["score"], 9) for r in quality_scores(awkward, none).collect()} == {0.3}
    got = quality_scores(awkward, some).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert quality_scores(empty, some).count() == 0


def test_fit_orders_by_a_clear_feature():
    x = np.zeros((100, FEATURES))
    x[:50, 3] = 1
    m = fit(x, x[:, 3] == 0, 0.3, pairs=500)
    assert (m.scores(x[50:]) >= 0.3).all() and (m.scores(x[:50]) < 0.3).all()
    assert features("").shape == (FEATURES,)


def test_threshold_is_a_quantile_between_the_classes():
    strength = np.array([0.1, 0.2, 0.3, 0.9, 1.0, 1.1, 1.2])
    level = quality.parting(strength, strength > 0.5)
    assert abs(np.quantile(strength, level) - (0.75 * 0.3 + 0.25 * 0.9)) < 1e-9
    assert np.quantile(np.ones(5), quality.parting(np.ones(5), np.array([True, False, True, True, False]))) == 1


def test_clashing_columns(spark, make):
    texts, labels = corpus()
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make(texts).selectExpr("*", "'mine' as score", "1 as predicted", "2 as held_out")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {(r["score"], r["predicted"], r["held_out"]) for r in kept.collect()} == {("mine", 1, 2)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.quality_scores(make(texts), labels).where("predicted = 1").collect())
