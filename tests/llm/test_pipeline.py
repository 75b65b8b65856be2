"""The pipeline end to end on planted documents, and each stage's contract."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

rng = random.Random(21)
WORDS = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    item, menu = prose(30), "Home | About us | Contact"
    good = [prose(120) for _ in range(60)]
    bad = [prose(100).upper().replace(" ", "!! ") for _ in range(20)]
    texts = good + bad
    texts[10] = " ".join(["changed", *texts[9].split()[1:]])  # near copy
    texts[11] = texts[9]
    texts[12] = f"{prose(50)} {item} {prose(50)}"
    texts = [f"{menu}\n{t}" if i % 2 == 0 else t for i, t in enumerate(texts)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, menu


def test_stages_keep_the_columns_and_take_effect(spark, corpus):
    folder, texts, menu = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        assert docs.columns == columns, name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) == set(range(60))
    assert set(seen[1]) == set(range(60)) and not any(menu in t for t in seen[1].values()) and seen[1][1] == texts[1]
    assert set(seen[2]) == set(range(60)) - {10, 11}
    assert set(seen[3]) == set(range(60)) - {10, 11, 12}


def test_run_packs_what_is_left(spark, corpus):
    folder, *_ = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == set(range(60)) - {10, 11, 12}
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
