from __future__ import annotations

import math
from collections import Counter, defaultdict

from cadenza.llm.urls import ORDER, SYMBOLS, judge_urls

URLS = [
    "https://a.com/x", "https://a.com", "http://WWW.Example.com/en/1?x", "http://example.com/en/2#t", "http://b.example.com/en/3", "https://c.net/es/4", "https://net/fr/5", "https://c.net/de/6", "https://good.org/1/x", "https://casino.net/org",
    None, "no scheme", "", "x://É.COM/ü?://", "http://://a.com/", "http://notexample.com/en/9", "https://c.net/es/4", "http://a.net?/es/", "http://a.net#/fr/x",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    path = rest[end:]
    stop = min([i for i, c in enumerate(path) if c in "?#"], default=len(path))
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), path[:stop]


def rule(host, path):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def ratios(urls, verdicts):
    """Witten-Bell interpolated log ratios, by loops over the texts."""
    form = lambda u: "".join("0" if c in "0123456789" else c if c in SYMBOLS[2:] else "~" for c in (u or "").translate({c: c + 32 for c in range(65, 91)}))
    n = {v: defaultdict(Counter) for v in ("allow", "block")}
    for u, v in zip(urls, verdicts):
        t = "^" * (ORDER - 1) + form(u)
        for i in range(ORDER - 1, len(t)):
            for k in range(ORDER):
                if v:
                    n[v][t[i - k : i]][t[i]] += 1

    def p(v, before, c):
        out = 1 / len(SYMBOLS)
        for k in range(ORDER):
            seen = n[v][before[len(before) - k :]]
            total = sum(seen.values()) + len(seen)
            out = (seen[c] + len(seen) * out) / total if total else out
        return out

    res = []
    for u in urls:
        t = "^" * (ORDER - 1) + form(u)
        xs = [math.log(p("allow", t[i - ORDER + 1 : i], t[i]) / p("block", t[i - ORDER + 1 : i], t[i])) for i in range(ORDER - 1, len(t))]
        res.append(sum(xs) / len(xs) if xs else 0.0)
    return res


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in judge_urls(df).collect()}
    by_rule = [rule(*parts(u)) for u in URLS]
    expected = ratios(URLS, [v for _, v in by_rule])
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*parts(u), by_rule[i][0])
        assert by_rule[i][1] is None or got[i]["verdict"] == by_rule[i][1]
        assert math.isclose(got[i]["ratio"], expected[i], abs_tol=1e-9), u
    free = [i for i, (name, _) in enumerate(by_rule) if name is None]
    order = sorted(free, key=lambda i: got[i]["ratio"])
    assert [got[i]["verdict"] for i in order] == sorted((got[i]["verdict"] for i in order), reverse=True)


def test_no_python_in_the_plan(spark):
    plan = judge_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_class_only_and_empty(spark):
    one = judge_urls(spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.org/"), (None, None)], "page_id long, url string")).collect()
    assert {r["verdict"] for r in one} == {"allow"} and {r["ratio"] for r in one} == {0.0}
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_very_long_urls(spark):
    """A megabyte of url takes time by its length."""
    import time

    rows = [(k, f"http://a{k}.com/" + f"xy{k}z/" * 40_000) for k in range(4)] + [(9, "http://q.net/es/" + "ä" * 300_000), (10, "http://r.com/")]
    began = time.monotonic()
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "verdict").collect()
    assert len(got) == 6 and time.monotonic() - began < 60
