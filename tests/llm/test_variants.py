"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import variants
from cadenza.llm.variants import deletion_keys, last_forms, near_words, spelling_variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least, times, slip, ratio):
    n: Counter = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                n[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    words = {w: k for w, k in n.items() if len(w) >= least and k >= times}
    out = {}
    for w, k in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best and words[best] >= ratio * k else None
        out[w] = [form, w, k, len(others), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("slip, alphabet", [(31, "abcdefgh"), (2, "ab"), (5, "aé÷ÿz")])
def test_all_words(spark, slip, alphabet):
    rng = random.Random(slip)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 9))) for _ in range(40)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(stems) if rng.random() < 0.9 else rng.choice(stems).upper() + "7" for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None), (98, "")], "doc_id long, text string")
    got = found(spelling_variants(docs, least=3, slip=slip, ratio=2))
    assert got == plain(rows, 3, 2, slip, 2)
    assert any(v[0] for v in got.values())


def test_keys_meet_where_strings_do():
    words = ["abcabca", "a", "zzzzzzzz", "ñandú" * 3, "x" * 5000]
    key, place, owner, first = deletion_keys(words)
    strings = [words[o] if p < 0 else words[o][:p] + words[o][p + 1 :] for p, o in zip(place, owner)]
    of = {}
    for s, k, p, o, f in zip(strings, key.tolist(), place, owner, first):
        assert of.setdefault(s, k) == k
        assert f == (p <= 0 or words[o][p] != words[o][p - 1])
    assert len(set(of.values())) == len(of)


def test_collisions_change_nothing(spark, monkeypatch):
    """Keys that say nothing put all words together; the strings part them again."""
    words = ["aaaaaaa", "aaaaaab", "aaaaab", "zzzzzzz", "zzzzzzzz"]
    docs = spark.createDataFrame([(1, " ".join(words * 2))], "doc_id long, text string")
    expected = found(spelling_variants(docs, least=3, slip=0))
    real = deletion_keys

    def same(some):
        key, place, owner, first = real(some)
        return np.zeros_like(key), place, owner, first

    monkeypatch.setattr(variants, "deletion_keys", same)
    assert found(spelling_variants(docs, least=3, slip=0)) == expected
    assert expected["zzzzzzz"][3] == 1 and expected["aaaaaab"][3] == 2


def test_chain_of_forms(spark, tmp_path):
    from cadenza.llm.shared import Scratch

    words = [f"{'x' * k}word" for k in range(6)]
    docs = spark.createDataFrame([(1, " ".join(" ".join([w] * 3**k) for k, w in enumerate(words)))], "doc_id long, text string")
    got = found(spelling_variants(docs, least=4, times=1, slip=0, ratio=3))
    assert {v[1] for v in got.values()} == {words[-1]}
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)], "word string, form string")
    assert {r["root"] for r in last_forms(forms, Scratch(spark, "t")).collect()} == {"w40"}


def test_awkward_rows(spark, awkward, empty):
    assert found(spelling_variants(empty)) == {}
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(spelling_variants(awkward.withColumn("word", awkward["lang"]).withColumn("n", awkward["n_chars"]), least=2)) == plain(rows, 2, 2, 31, 10)
    long = "q" * 30_000
    docs = spark.createDataFrame([(1, f"{long} {long} {long[1:]} {long[1:]}")], "doc_id long, text string")
    assert [v[3] for v in found(spelling_variants(docs, slip=0)).values()] == [1, 1]
    many = spark.createDataFrame([(i, "repeated repeated repeatec") for i in range(400)], "doc_id long, text string")
    assert found(spelling_variants(many, slip=0)) == {"repeated": (None, "repeated", 800, 1, None), "repeatec": (None, "repeatec", 400, 1, None)}


def test_tables_flow_over(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"{'abcdefghij'[j]}{'klmnopqrst'[i % 10]}common" for j in range(10))) for i in range(50)], "doc_id long, text string")
    expected = found(spelling_variants(docs))
    monkeypatch.setattr(variants, "_TABLE_WORDS", 3)
    assert found(spelling_variants(docs)) == expected and near_words is variants.near_words
