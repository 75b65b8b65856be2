from __future__ import annotations

import random
import re
import time

from cadenza.llm.licenses import HINTS, TEMPLATES, Scanner, scan_licenses
from cadenza.llm.wording import lcs_length


def test_every_notice_is_found_where_it_stands(make):
    texts = [f"é words before it.\n{t} and words after it {'x ' * 200}" for t in TEMPLATES.values()]
    got = {r["doc_id"]: r for r in scan_licenses(make(texts)).collect() if r["exact"]}
    for i, (name, t) in enumerate(TEMPLATES.items()):
        assert (got[i]["license"], got[i]["start"], got[i]["end"], got[i]["missing_words"]) == (name, texts[i].index(t), texts[i].index(t) + len(t), 0)


def test_other_wordings(make):
    texts = [
        "this work is LICENSED under the GNU General Public License version 3!", "This work is licensed under the GNU General Public License, version 2.",
        "He has a license to drive.", "All rights are reserved", "two: All rights reserved. Released under the MIT License.",
    ]
    got = [(r["doc_id"], r["license"], r["exact"]) for r in scan_licenses(make(texts)).orderBy("doc_id", "start").collect()]
    assert got == [(0, "GPL-3.0", False), (4, "reserved", True), (4, "MIT", True)]


def test_wrapped_notices():
    scan = Scanner(TEMPLATES, HINTS, 0.15)
    for name, t in TEMPLATES.items():
        for between, lead in (("\n# ", "# "), ("  ", ""), ("\n * ", "/* "), ("\n", ""), ("\t// ", "// ")):
            for every in (1, 3):
                words = t.split(" ")
                notice = "".join(w + (between if k % every == 0 else " ") for k, w in enumerate(words[:-1])) + words[-1]
                text = f"{'word ' * 60}\n{lead}{notice} and {'more ' * 60}"
                got = [(f[0], text[f[1] : f[2]], *f[4:]) for f in scan(text)]
                assert got == [(name, notice, 0, 0, False)], (name, between, every, got)


def test_numbers_of_other_versions():
    scan = Scanner(TEMPLATES, HINTS, 0.15)
    for text in ("This work is licensed under the GNU General Public License, version 2. 3 people.", "This work is licensed under the GNU General Public License, version 2, section 3."):
        assert scan(text) == []


def test_lcs_against_brute_force():
    def brute(a, b):
        return 0 if not a or not b else 1 + brute(a[1:], b[1:]) if a[0] == b[0] else max(brute(a[1:], b), brute(a, b[1:]))

    for a, b in (("abcbdab", "bdcaba"), ("", "a"), ("aaa", "aa"), ("xyz", "abc")):
        assert lcs_length(list(a), list(b)) == brute(a, b)


def test_headers_as_files_have_them():
    scan = Scanner(TEMPLATES, HINTS, 0.15)
    apache = TEMPLATES["Apache-2.0-text"].split(" ")
    lines = [" * " + " ".join(apache[k : k + 9]) for k in range(0, len(apache), 9)]
    assert [f[0] for f in scan("/*\n" + "\n".join(lines) + "\n */\npackage x;")] == ["Apache-2.0-text"]
    mit = TEMPLATES["MIT-text"].replace("AUTHORS OR COPYRIGHT HOLDERS", "CONTRIBUTORS").replace("free of charge, ", "wholly and entirely free of all charge, ")
    (got,) = scan("Copyright 2020 X\n\n" + mit)
    assert got[0] == "MIT-text" and got[4] == 4 and got[5] == 5 and not got[6]


def plain_lcs(a, b):
    """By the textbook table; nothing of the code under test."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(text):
    """Templates of which some stretch of words holds 85 % in order and all numbers, by trying every stretch."""
    words, out = re.findall(r"[\w.]*\w", text.lower()), {}
    for name, template in TEMPLATES.items():
        want = re.findall(r"[\w.]*\w", template.lower())
        numbers = {w for w in want if any(c.isdigit() for c in w)}
        for a in range(len(words)):
            here = words[a : a + len(want) + 2 + len(want) // 4]
            if here[0] in want and numbers <= set(here) and sum(w in here for w in want) >= 0.85 * len(want):
                out[name] = max(out.get(name, 0), plain_lcs(want, here))
    return {name: n for name, n in out.items() if n >= 0.85 * len(re.findall(r"[\w.]*\w", TEMPLATES[name]))}


def test_changed_notices_against_brute_force():
    rng, scan = random.Random(8), Scanner(TEMPLATES, HINTS, 0.15)
    short = [n for n, t in TEMPLATES.items() if len(t) < 260]
    for _ in range(80):
        name = rng.choice(short)
        words = TEMPLATES[name].split(" ")
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            if not any(c.isdigit() for c in words[k]):
                words[k : k + rng.randint(0, 1)] = [] if rng.random() < 0.3 else [rng.choice(["the", "other", "open", "License", "version"])]
        text = "some words first " + " ".join(words) + " and others then"
        got, want = [f[0] for f in scan(text)], brute(text)
        hinted = scan.hint.search(text.lower()) is not None
        assert set(got) <= set(want) and bool(got) == (bool(want) and hinted), (text, got, want)
        if got:  # the notice with most of its words there is among those found
            assert max(want.values()) - max(want[g] for g in got) <= 1, (text, got, want)


def test_compression_ranks_and_wording_confirms(monkeypatch):
    """Every template is compressed against a block before any wording is read, and the first confirmed one wins."""
    scan, order = Scanner(TEMPLATES, HINTS, 0.15), []
    real = Scanner.confirmed
    monkeypatch.setattr(Scanner, "confirmed", lambda self, words, here: order.append(" ".join(words)) or real(self, words, here))
    text = "see: " + TEMPLATES["LGPL-2.1-header"].replace("Lesser ", "lesser,  ").replace("free software", "free  software") + " end"
    assert [f[0] for f in scan(text)] == ["LGPL-2.1-header"]
    assert order[0].startswith("this library is free software") and len(order) < 27 * 3
    other = "The license of this house is a fishing license and it is not for sale to any person."
    assert scan(other) == []


def test_clashing_columns(make):
    docs = make(["Released under the MIT License."]).selectExpr("*", "text as license", "doc_id as start", "n_chars as end")
    assert [(r["doc_id"], r["license"]) for r in scan_licenses(docs).collect()] == [(0, "MIT")]


def test_many_notices_in_one_text():
    scan, began = Scanner(TEMPLATES, HINTS, 0.15), time.monotonic()
    found = scan("All rights reserved. Released under the MIT License. " * 3000)
    assert len(found) == 6000 and all(f[-1] for f in found) and time.monotonic() - began < 60


def test_awkward_rows(awkward, empty):
    assert scan_licenses(awkward).count() == 0 and scan_licenses(empty).count() == 0
