from __future__ import annotations

from collections import Counter

from cadenza.llm import lines

SCHEMA = "doc_id long, text string, source string, n_lines int"


def brute(rows, ratio, least):
    totals, seen = Counter(s or "" for _, _, s in rows), Counter()
    for _, t, s in rows:
        seen.update({(s or "", x.strip(" ")) for x in (t.split("\n") if t is not None else []) if x.strip(" ")})
    bad = {k for k, n in seen.items() if n >= least and n > ratio * totals[k[0]]}
    out = []
    for d, t, s in rows:
        every = t.split("\n") if t is not None else []
        stay = [x for x in every if not x.strip(" ") or (s or "", x.strip(" ")) not in bad]
        out.append((d, None if t is None else "\n".join(stay), len(every), len(every) - len(stay)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = [(i, "\n".join(["menu", f"own {i}", " menu ", "", "é footer" if i % 3 == 0 else "x", f"shared {i % 9}"]), "a" if i % 2 else "b") for i in range(60)]
    rows += [(100, None, "a"), (101, "", None), (102, "menu", "c"), (103, "\n\n", None), (103, "\n\n", None), (None, "menu\nmenu", "a")]
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    for small in (True, False):
        monkeypatch.setattr(lines, "is_small", lambda df, small=small: small)
        got = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(df, ratio=0.2, min_pages=3).collect()]
        assert sorted(got, key=str) == brute(rows, 0.2, 3)


def test_awkward_rows(awkward, empty):
    got = lines.drop_boilerplate(awkward)
    assert got.count() == 8 and got.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert lines.drop_boilerplate(empty).count() == 0


def test_clashing_columns_and_dealt_hosts(make, monkeypatch):
    texts = ["menu\nbody %d" % i for i in range(40)] + [None, "", "other"]
    docs = make(texts).selectExpr("*", "1 as host_key", "2 as Common", "3 as kept_lines", "4 as part", "5 as n_lines")
    want = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(docs).collect())
    assert want[0] == (0, "body 0", 2, 1)
    monkeypatch.setattr(lines, "is_small", lambda df: False)
    out = lines.drop_boilerplate(docs)
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == want
    assert {(r["host_key"], r["Common"], r["kept_lines"], r["part"]) for r in out.collect()} == {(1, 2, 3, 4)}
