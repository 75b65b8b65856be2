from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cadenza.llm.packing import TokenIds, pack, plan

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference_ids():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", None, "plain words here", "it 's  two   spaces\n\n and\ttabs \x1c\x85 x", "don't <|endoftext|> é ü y 🎈🎈 1,234.5", "<|endoftext|>first", "a  <|endoftext|><|endoftext|>  b<|endoftext|>", "near <|endoftext> |endoftext|> <|endoftext|", " lead and trail ", "a" * 3000, "\n".join("line %d" % i for i in range(900))]


def test_ids_equal_the_tokenizer(reference_ids):
    ids = TokenIds(PATH)
    rng = random.Random(3)
    signs = [*"ab Z9.,'\"\n\t  é中🎈 \x1c-_", "<|endoftext|>"]
    for text in [t or "" for t in TEXTS] + ["".join(rng.choice(signs) for _ in range(80)) for _ in range(300)]:
        assert np.frombuffer(ids(text), "<u4").tolist() == reference_ids(text), text


def check(docs, rows, ids_of, size):
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for doc, text in docs:
        ids = [*ids_of(text), 2]
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(ids)
        at = 0
        for k, p in enumerate(parts):
            assert p["start"] == at and (p["length"] == size or k == 0)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
    return len(places)


def test_round_trip(make, reference_ids):
    rows = pack(make(TEXTS * 3).repartition(3), PATH, size=64).collect()
    used = check(list(enumerate(TEXTS * 3)), rows, reference_ids, 64)
    assert used <= -(-sum(r["length"] for r in rows) // 64) * 1.1 + 1


def test_plan_fills_well_and_places_every_rank():
    rng = random.Random(1)
    counts = {n: rng.randint(0, 400) for n in range(1, 65)}
    runs = plan(counts, 64)
    ranks = defaultdict(list)
    for length, low, high, *_ in runs:
        ranks[length] += range(low, high)
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    used = max(s + high - low for _, low, high, s, _ in runs)
    assert used <= 1.02 * sum(n * c for n, c in counts.items()) / 64


def test_awkward_rows(awkward, empty):
    got = pack(awkward, PATH).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, None}
    assert sum(r["doc_id"] == 5 for r in got) == 2
    assert [r["length"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    assert pack(empty, PATH).count() == 0


def test_long_texts_have_the_same_ids(monkeypatch):
    from cadenza.llm.queries import tokenizer_path

    from cadenza.llm import packing

    ids = packing.TokenIds(tokenizer_path())
    texts = ["", " ", "a  b\n\nc. d, é 🎈 don't 12 345", "word " * 5000, "\t\n x"]
    short = [ids(t) for t in texts]
    monkeypatch.setattr(packing, "LONG", 0)
    assert [ids(t) for t in texts] == short
