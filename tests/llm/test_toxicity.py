"""The convolutional classifier: held-out documents, plain recomputation of its values, awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import toxicity
from cadenza.llm.toxicity import Vocabulary, drop_toxic, fit, letter_groups, letters, parting, toxicity_scores

BAD = ("vilework", "grossish", "nastyfolk")


def texts(n, seed=3):
    """Two invented languages; one in five texts holds a form of a bad stem."""
    rng = random.Random(seed)
    syllables = ("ka lo mi ta re su".split(), "schü ver ung heit zö aß".split())
    out = []
    for i in range(n):
        of = syllables[i % 2]
        words = ["".join(rng.choice(of) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        toxic = i % 5 < 1
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD)[:6] + rng.choice(of))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(700)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


@pytest.fixture(scope="module")
def model():
    rows = texts(500)
    return fit([t for _, t, _ in rows], np.array([b for *_, b in rows]), 0.2)


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == len(rows)
    right = n = 0
    for i, _, toxic in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"]:
            n, right = n + 1, right + (r["predicted"] == int(toxic))
    assert n > 100 and right / n > 0.97


def test_labels_of_held_out_rows_and_other_columns_are_not_read(tables):
    _, docs, labels = tables
    plain = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, labels).collect()}
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")).withColumn("score", F.lit("clash"))
    assert {r["doc_id"]: r["score"] for r in toxicity_scores(other, wrong).collect()} == plain


def test_awkward_rows(spark, tables, awkward, empty):
    _, _, labels = tables
    assert toxicity_scores(empty, labels).collect() == [] and drop_toxic(empty, labels).columns == empty.columns
    for some in (labels, labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        rows = toxicity_scores(awkward, some).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] < 1 for r in rows)
        assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert all(r["predicted"] == 0 for r in toxicity_scores(awkward, labels.limit(0)).collect())
    assert drop_toxic(awkward.withColumn("score", F.lit(1)), labels.limit(0)).count() == awkward.count()


def test_values_are_those_of_the_definition(model):
    """Maxima over all windows of summed filter rows, word by word."""
    text = "ka lo vilewor ta schüver mi ka"
    vocabulary = Vocabulary()
    docs = vocabulary([text, "", "lo"])
    rows = np.array(vocabulary.rows)
    net = model.net
    for doc, got in zip(docs, net.logits(docs, rows)):
        e = [np.zeros(toxicity.WIDTH) if k == 0 else sum(net.table[r] for r in vocabulary.rows[k]) for k in doc]
        pooled = []
        for w, f in zip(toxicity.FILTER_WIDTHS, net.filters):
            pooled += [max(sum(float(e[a + j] @ f[j][:, c]) for j in range(w)) for a in range(len(e) - w + 1)) for c in range(toxicity.FILTERS)]
        assert got == pytest.approx(float(np.array(pooled) @ net.out + net.bias), abs=1e-3)


def test_pieces_and_forgetting_change_nothing(model, monkeypatch):
    some = [t for _, t, _ in texts(80, 9)] + [""]
    plain = model.scores(some, Vocabulary())
    vocabulary = Vocabulary(20)
    assert np.allclose(np.concatenate([model.scores(some[k : k + 7], vocabulary) for k in range(0, len(some), 7)]), plain, atol=1e-5)
    monkeypatch.setattr(toxicity, "_PIECE_WORDS", 4)
    assert np.allclose(model.scores(some, Vocabulary()), plain, atol=1e-5)


def test_toxic_words_in_a_long_clean_text(model):
    clean = " ".join(t for _, t, b in texts(4000, 21) if not b)
    at = len(clean) // 2
    scores = model.scores([clean, clean[:at] + " vilewoka nastyfmi " + clean[at:]], Vocabulary())
    assert scores[0] < 0.5 <= scores[1]


def test_languages_by_letters():
    some = [t for _, t, _ in texts(200)]
    x = np.array([letters(t) for t in some])
    group = (x @ letter_groups(x, 2).T).argmax(axis=1)
    assert len(set(group[::2])) == len(set(group[1::2])) == 1 and group[0] != group[1]


def test_threshold():
    z, bad = np.array([0.0, 1.0, 2.0, 5.0, 6.0]), np.array([False, False, False, True, True])
    assert parting(z, bad, 0.2) == 3.5
    assert parting(np.array([1.0, 1.0]), np.array([False, True]), 0.5) == 1.0


def test_all_labelled_rows_are_learned_from(spark, tables, monkeypatch):
    """In many parts, each row once: the network and the centres are not those of the first rows alone."""
    rows, docs, labels = tables
    monkeypatch.setattr(toxicity, "PART", 90)
    read = []
    plain = toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda *a: read.append(a[5].sum()) or plain(*a))
    model, again = toxicity.train(docs, labels), toxicity.train(docs, labels)
    learned = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(learned) / 5 < read[0] < len(learned) / 3
    assert np.array_equal(model.net.table, again.net.table) and np.array_equal(model.thresholds, again.thresholds)
    new = texts(300, 17)
    right = [(s >= 0.5) == b for (_, _, b), s in zip(new, model.scores([t for _, t, _ in new], Vocabulary()))]
    assert sum(right) / len(right) > 0.95


def test_long_texts_are_learned_from(spark, tables):
    """All toxic ones have over 100,000 characters."""
    _, docs, labels = tables
    clean = " ".join(t for _, t, b in texts(1200, 21) if not b)
    clean = (clean * (1 + 101_000 // len(clean)))[:101_000]
    longer = docs.where("doc_id < 60").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" " + clean))).otherwise(F.col("text")))
    assert toxicity.train(longer, labels) is not None


def test_places_over_pieces(model, monkeypatch):
    some = [t for _, t, _ in texts(40, 9)]
    vocabulary = Vocabulary()
    docs = vocabulary(some)
    pooled, places = model.net.places(docs, np.array(vocabulary.rows))
    monkeypatch.setattr(toxicity, "_PIECE_WORDS", 4)
    again, others = model.net.places(docs, np.array(vocabulary.rows))
    assert np.allclose(pooled, again, atol=1e-5) and pooled.shape == (40, 36) and sum((a == b).mean() for a, b in zip(places, others)) > 2.9
