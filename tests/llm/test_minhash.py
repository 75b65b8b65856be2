from __future__ import annotations

import random
import re

import numpy as np

from cadenza.llm import minhash
from cadenza.llm.minhash import components, near_duplicates, shingle_sets, sketches
from cadenza.llm.shared import Scratch

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, n, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def texts():
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(6)]
    out = ["", None, " \n", "Alone", "alone", "two words", "Two  WORDS"]
    for b in base:
        for _ in range(14):
            c = list(b)
            for _ in range(rng.randint(0, 5)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            out.append(" ".join(c))
    return out


def test_against_brute_force(make):
    rows = texts()
    for n in (2, 5):
        got = {r[0]: tuple(r[1:]) for r in near_duplicates(make(rows), n=n).collect()}
        assert got == brute(list(enumerate(rows)), n, 80)


def test_rare_shingle_pairs_against_brute_force(spark, make, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 0)  # every crowd is joined on rare shingles
    rows = texts()
    got = {r[0]: tuple(r[1:]) for r in near_duplicates(make(rows), n=2).collect()}
    assert got == brute(list(enumerate(rows)), 2, 80)


def template_pages(n, own, shared=160):
    rng = random.Random(6)
    frame = [f"t{i}" for i in range(shared)]
    return [" ".join(w for k, t in enumerate(frame) for w in ([t, f"w{rng.randrange(10**6)}"] if k % (shared // own) == 0 else [t])) for _ in range(n)]


def test_pages_of_one_template_make_no_pairs(spark, make):
    rows = template_pages(400, 40) + template_pages(300, 10) + [t + " end" for t in template_pages(40, 40)[:20]]
    got = {r[0]: tuple(r[1:]) for r in near_duplicates(make(rows), n=2).collect()}
    assert got == brute(list(enumerate(rows)), 2, 80)


def test_prefix_places_leave_no_link_out(spark):
    rng, scratch = random.Random(11), Scratch(spark, "test")
    sets = {}
    for i in range(150):
        start = sets[rng.randrange(i)] if i and rng.random() < 0.7 else {rng.randrange(400) for _ in range(rng.randint(1, 60))}
        sets[i] = {x for x in start if rng.random() > 0.1} | {rng.randrange(400) for _ in range(rng.randint(0, 4))} or {1}
    members = spark.createDataFrame([(i, len(s), i if i % 5 else 0) for i, s in sets.items()], "rep long, n long, component long")
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, shingles array<long>")
    got = {tuple(r) for r in minhash.rare_shingle_pairs(members, rows, 80, scratch).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and (a % 5 or b % 5) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want <= got and len(got) < 150 * 149 / 4


def test_awkward_rows(awkward, empty):
    got = sorted(tuple(r) for r in near_duplicates(awkward, n=2).collect())
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 5, 6]
    assert all(r[1] == 0 and r[3] for r in got[:3]) and got[4] == (5, 1, 5, True) == got[5]
    assert near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity_and_fills():
    row, value = shingle_sets([" ".join(map(str, range(400))), " ".join(map(str, range(40, 440))), "a"], 1)
    s = sketches(row, value, 3, 512)
    assert (s < np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.08


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
