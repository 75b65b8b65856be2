from __future__ import annotations

import random

import numpy as np

from cadenza.llm import decontaminate
from cadenza.llm.decontaminate import PARAPHRASE, VERBATIM, drop_leaks, find_leaks, last_sentence, passages, randomised_basis, split_words
from cadenza.llm.wording import lcs_length

rng = random.Random(12)
VOCABULARY = ["the", "of", "in", "and"] * 40 + ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(3000)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ITEMS = [prose(n) + ". " + prose(6) + "." for n in (10, 15, 30, 45, 25, 40)]


def paraphrased(text):
    words = text.split()
    for i in range(0, len(words) - 6, 4):
        words[i] = rng.choice(VOCABULARY)
    return " ".join(words)


def test_planted_items_are_found_and_clean_ones_are_not(spark, make):
    texts = [prose(200) for _ in range(30)]
    for i, item in enumerate(ITEMS):
        texts.append(f"{prose(80)} {item} {prose(70)}")
        texts.append(item.upper())
        texts.append(f"{prose(60)} {paraphrased(item)} {prose(60)}")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in find_leaks(make(texts), bench).collect()}
    assert all(got[30 + 3 * i, i] == got[31 + 3 * i, i] == "verbatim" for i in range(len(ITEMS)))
    assert sum((32 + 3 * i, i) in got for i in range(len(ITEMS))) >= 5 and len(got) <= 18
    kept = sorted(r["doc_id"] for r in drop_leaks(make(texts), bench).collect())
    assert kept == sorted(set(range(len(texts))) - {d for d, _ in got})
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(make(texts), bench, block=2).collect()} >= {k for k, v in got.items() if v == "verbatim"}


def test_recall_of_a_benchmark_beyond_the_rank(spark, make):
    draw = random.Random(5)
    items = [" ".join(draw.choice(VOCABULARY) for _ in range(draw.randint(18, 55))) + ". " + prose(6) + "." for _ in range(1000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    copies = {k: f"{prose(40)} {items[k]} {prose(40)}" if k % 2 else items[k] for k in range(0, 1000, 13)}
    changed = {k: paraphrased(items[k]) for k in range(6, 1000, 13)}
    texts = [*copies.values(), *changed.values(), *(prose(150) for _ in range(20))]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in find_leaks(make(texts), bench).collect()}
    assert all(got.get((d, k)) == "verbatim" for d, k in enumerate(copies))
    assert all((d, k) in got for d, k in enumerate(changed, len(copies)))
    assert len(got) == len(copies) + len(changed)


def test_basis_spans_the_leading_directions(spark):
    rows = np.random.default_rng(1).standard_normal((60, 5)) @ np.random.default_rng(2).standard_normal((5, 40))
    df = spark.createDataFrame([(list(range(40)), r.tolist()) for r in rows], "ids array<int>, weights array<double>").repartition(3)
    q = randomised_basis(df, 40, 5)
    assert np.allclose(rows @ q @ q.T, rows, atol=1e-4) and np.allclose(q.T @ q, np.eye(5), atol=1e-5)


def test_passages_cover_everything():
    assert passages(0, 24, 8) == [] and passages(5, 24, 8) == [(0, 5)] and passages(40, 24, 8) == [(0, 24), (8, 32), (16, 40)]


def test_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four"), (None, "no id here"), (3, "one two three four")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in find_leaks(awkward, bench).collect()]
    assert got == [(None, None)]
    assert drop_leaks(awkward, bench).count() == 7 and drop_leaks(empty, bench).count() == 0
    assert find_leaks(awkward, bench.limit(0)).count() == 0


def test_recall_against_exact_subsequences(spark, make):
    """Every stretch of every document against every item, by longest common subsequence alone."""
    draw = random.Random(31)
    items = [" ".join(draw.choice(VOCABULARY) for _ in range(draw.randint(20, 45))) + ". " + " ".join(draw.choice(VOCABULARY) for _ in range(5)) + "." for _ in range(25)]
    texts = []
    for k in range(75):
        words = items[k % 25].split()
        for i in range(len(words) - 5):
            if draw.random() < (0.05, 0.2, 0.35)[k // 25]:
                words[i] = draw.choice(VOCABULARY)
        texts.append(f"{prose(40)} {' '.join(words)} {prose(40)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(make(texts), bench).collect()}
    want = set()
    for d, text in enumerate(texts):
        words = split_words(text)
        for k, item in enumerate(items):
            own, answer = split_words(item), split_words(last_sentence(item))
            for a in range(0, len(words), 2):
                here = words[a : a + len(own) + 8]
                covered = lcs_length(own, here) / len(own)
                if covered >= VERBATIM or covered >= PARAPHRASE and lcs_length(answer, here) >= VERBATIM * len(answer):
                    want.add((d, k))
                    break
    print("recall", len(got & want) / len(want), "of", len(want))
    assert len(want) >= 60 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 2


def test_blocks_are_bounded_by_items_and_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    bench = spark.createDataFrame([(i, f"w{i} x{i} y{i} the") for i in range(100)] + [(500, prose(400))], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, 40))
    assert sorted(item.item_id for b in blocks for item in b) == [*range(100), 500]
    assert all(len(b) <= 40 and (len(b) == 1 or len({w for item in b for w in item.words}) <= 60) for b in blocks)


def test_short_items_are_found_wherever_they_stand(spark, make):
    """Items of 3 to 23 words, of rare and of common words, verbatim and with a word left out or put in."""
    draw = random.Random(77)
    rare = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(4)) for _ in range(900)]
    items = [" ".join(draw.choice(VOCABULARY if n % 2 else rare) for _ in range(n)) for n in range(3, 24)]
    texts, want = [], set()
    for k, item in enumerate(items):
        words = item.split()
        for d, put in enumerate((words, [w.upper() for w in words], words[:1] + ["qqq"] + words[1:])):
            if d == 2 and len(words) < 4:
                continue
            want.add((len(texts), k))
            texts.append(f"{prose(61)} {' '.join(put)} {prose(150)}")
    clean = [prose(300) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(make([*texts, *clean]), bench).collect() if r["kind"] == "verbatim"}
    assert want <= got
    extra = {(d, k) for d, k in got - want if not stretch_holds(split_words([*texts, *clean][d]), split_words(items[k]))}
    assert not extra


def stretch_holds(words, item):
    """Whether some stretch of the item's length and a quarter more has 80 % of it in order, by trying all."""
    span = len(item) + len(item) // 4
    return any(lcs_length(item, words[a : a + span]) >= VERBATIM * len(item) - 1e-9 for a in range(len(words)))


def test_short_items_against_all_stretches(spark, make):
    draw = random.Random(78)
    few = "a b c d e f".split()
    items = [" ".join(draw.choice(few) for _ in range(draw.randint(3, 7))) for _ in range(12)]
    texts = [" ".join(draw.choice([*few, "x", "y", "z"] * (1 if d % 2 else 3) + ["x"] * 9) for _ in range(60)) for d in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(make(texts), bench).collect() if r["kind"] == "verbatim"}
    want = {(d, k) for d, t in enumerate(texts) for k, i in enumerate(items) if stretch_holds(split_words(t), split_words(i))}
    assert want and want <= got


def test_many_blocks_are_written_one_by_one(spark, make):
    items = [prose(30) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{prose(50)} {i} {prose(50)}" for i in items]
    found = find_leaks(make(texts), bench, block=1)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect() if r["kind"] == "verbatim"} >= {(k, k) for k in range(20)}
    assert found.inputFiles() and "MapInPandas" not in found._jdf.queryExecution().toString()


def test_clashing_columns(spark, make):
    item = prose(30)
    docs = make([f"{prose(40)} {item} {prose(40)}", prose(60)]).selectExpr("*", "doc_id as item_id", "text as kind", "text as answer", "lang as text_hash")
    bench = spark.createDataFrame([(7, item, "x", 1)], "item_id long, text string, kind string, doc_id long")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()] == [(0, 7)]
    assert drop_leaks(docs, bench).columns == docs.columns and drop_leaks(docs, bench).count() == 1


def test_hashes_by_parts(monkeypatch):
    texts = ["", "one", " a  b ", "x" * 300, " ".join(f"w{i}" for i in range(200)), "é ü-ß 🎈"]
    value, edges = decontaminate.words_of(texts)
    assert np.diff(edges).tolist() == [len(split_words(t)) for t in texts]
    assert len(set(value.tolist())) == len({w for t in texts for w in split_words(t)})
    monkeypatch.setattr(decontaminate, "_PART", 40)
    again = decontaminate.words_of(texts)
    assert (again[0] == value).all() and (again[1] == edges).all()
