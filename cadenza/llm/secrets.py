"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams: an AND of trigrams that cover each literal
it cannot match without, an OR over alternatives. The index is a table of postings (trigram, document), sorted by
trigram within its files, that one pass over the texts fills for the trigrams that some query names. The postings of a
conjunction's trigrams are intersected over all documents at once, and only documents in an intersection are verified
with the expression itself. A rule that no literal of three letters is mandatory for scans all texts.

Spans count code points and end exclusively. They follow from lengths: what lies between matches (split) and the
matches themselves (regexp_extract_all) alternate. Spans that start alike are ordered by rule; equal spans of two rules
are both reported.

Null text counts as empty and has no spans; an empty table gives no rows. Rows with a null doc_id are not in the index;
they are scanned for every rule. Repeated rows are reported once each; rows of one doc_id share their candidate rules,
which verifying settles. Only doc_id and text are read, so other columns may have any names. The work on a text grows
with its length and, for its matches, as their number to the power 1.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, broadcast_if_small, span_digest


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length is held against `least`
    least: int = 0
    base: bool = False


#: The three base rules of the contract, in its order, then the rules that this method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # leftmost runs of [0-9a-f]+, of which shorter ones would fail
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository", r"(ghp_|gho_|ghs_|glpat-)[A-Za-z0-9_-]{20,}"),
    Rule("chat", r"(xoxb-|xoxp-|xoxa-|xoxs-)[A-Za-z0-9-]{10,}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{30,}"),
)


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """The trigrams (lower case) of a text that the pattern can match, as an OR of ANDs; None if none is mandatory.

    Works on what Python's own parser makes of the pattern; only literals, sequences, groups, alternatives and
    repeats of at least one matter, everything else ends a literal run.
    """
    from re import _constants as c
    from re import _parser

    def join(left: list[tuple], right: list[tuple]) -> list[tuple]:
        out = []
        for done, run in left:
            for more, head, whole, tail in right:
                text = run + head
                out.append((done | more | ({text} if not whole else set()), text if whole else tail))
        return out

    def of(items) -> list[tuple]:
        """Ways as (complete literals, the literal run still open at the end)."""
        ways: list[tuple] = [(frozenset(), "")]
        for op, value in items:
            if op is c.LITERAL:
                part = [(frozenset(), chr(value), True, "")]
            elif op is c.SUBPATTERN:
                part = closed(value[-1])
            elif op is c.BRANCH:
                part = [x for branch in value[1] for x in closed(branch)]
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and value[0] >= 1:
                part = [(done, "", False, "") for done, *_ in closed(value[2], whole=False)]
            else:
                part = [(frozenset(), "", False, "")]
            ways = [(frozenset(a), b) for a, b in join(ways, part)]
            if len(ways) > 64:
                return [(frozenset(), "")]
        return ways

    def closed(items, whole: bool = True) -> list[tuple]:
        plain = all(op is c.LITERAL for op, _ in items)
        if plain and whole:
            return [(frozenset(), "".join(chr(v) for _, v in items), True, "")]
        return [(done | {run}, "", False, "") for done, run in of(items)]

    ands = []
    for done, run in of(_parser.parse(pattern)):
        words = {w.lower() for w in {*done, run} if len(w) >= 3 and w.isascii()}
        grams = frozenset(w[i : i + 3] for w in words for i in {*range(0, len(w) - 2, 3), len(w) - 3})
        if not grams:
            return None
        ands.append(grams)
    return frozenset(x for x in ands if not any(y < x for y in ands))


def _one_of(grams: list[str]) -> str:
    """An expression that matches, without consuming it, any of the trigrams at a place; a test of three letter classes comes first."""
    signs = lambda cs: "[" + "".join(c if c.isalnum() else "\\" + c for c in sorted(cs)) + "]"
    heads = sorted({g[0] for g in grams})

    def among(heads: list[str]) -> str:
        if len(heads) <= 2:
            return "|".join(f"{re.escape(h)}(?:{'|'.join(re.escape(g[1:]) for g in grams if g[0] == h)})" for h in heads)
        half = len(heads) // 2
        return "|".join(f"(?={signs(part)})(?:{among(part)})" for part in (heads[:half], heads[half:]))

    return f"(?={''.join(signs({g[k] for g in grams}) for k in range(3))})(?=({among(heads)}))"


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id) for the named trigrams, whatever case they stand in: one pass over each text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_one_of(grams)), F.lit(1)))
    return docs.select(F.explode(found).alias("gram"), "doc_id").sortWithinPartitions("gram")


def intersected(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """(doc_id, kinds): the rules of whose conjunctions one has the document in the postings of all its trigrams."""
    conjunctions = [(kind, sorted(grams)[:62]) for kind, query in queries.items() for grams in sorted(query, key=sorted)]
    terms = [(g, c, kind, 1 << k, (1 << len(gs)) - 1) for c, (kind, gs) in enumerate(conjunctions) for k, g in enumerate(gs)]
    terms = index.sparkSession.createDataFrame(terms, "gram string, conjunction int, kind string, bit long, whole long")
    lists = index.join(F.broadcast(terms), "gram")  # as many rows as the rules have trigrams
    hits = lists.groupBy("doc_id", "conjunction", "kind", "whole").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    return hits.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))  # at most the rules


def candidates(docs: DataFrame, queries: dict[str, frozenset[frozenset[str]]], scratch: Scratch) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document's postings satisfy."""
    grams = sorted({g for query in queries.values() for gs in query for g in gs})
    index = scratch.keep(postings(docs.where("doc_id is not null"), grams), "postings")
    kept = scratch.keep(intersected(index, queries), "candidates")
    scratch.drop("postings")
    return kept


def running_starts(gaps: Column, lengths: Column) -> Column:
    """array<int>: where each item starts when gaps and items of the given lengths alternate.

    A fold that copies its output costs the square of what it folds over, so sums run over blocks of about the square
    root of the number of items, and within each block.
    """
    empty = F.expr("cast(array() as array<int>)")

    def sums(xs: Column, first: Column) -> Column:
        """first and its running sums with all of xs; one more than xs has."""
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def within(steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / size).cast("int") - 1), lambda k: F.slice(steps, k * size + 1, size))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        pairs = F.arrays_zip(blocks.alias("block"), F.slice(sums(totals, F.lit(0)), 1, F.size(totals)).alias("before"))
        return F.flatten(F.transform(pairs, lambda p: F.slice(sums(p["block"], p["before"]), 2, F.size(p["block"]))))

    # a start is the sum of all gaps and lengths before it: each step is a gap and the length before it
    steps = F.zip_with(gaps, F.concat(F.array(F.lit(0)), F.slice(lengths, 1, F.size(lengths) - 1)), lambda g, n: g + n)
    return F.when(F.size(gaps) == 0, empty).otherwise(F.element_at(F.transform(F.array(steps), within), 1))


def match_spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of the rule's leftmost non-overlapping matches that pass its length test.

    text must hold a match.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    tested = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    lengths = lambda xs: F.transform(xs, F.char_length)

    def spans(p: Column) -> Column:
        zipped = F.arrays_zip(running_starts(p["gap"], p["n"]).alias("start"), p["n"].alias("n"), p["t"].alias("t"))
        passed = F.filter(zipped, lambda s: s["t"] >= rule.least)
        return F.transform(passed, lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].cast("long").alias("start"), (s["start"] + s["n"]).cast("long").alias("end")))

    # bound in a lambda, so that the texts are matched once
    return F.element_at(F.transform(F.array(F.struct(lengths(gaps).alias("gap"), lengths(whole).alias("n"), lengths(tested).alias("t"))), spans), 1)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the spans found, array<struct<kind, start, end>> by rule, then start; a row for every document."""
    scratch = Scratch(docs.sparkSession, "secrets")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    kept = candidates(docs, queries, scratch)
    joined = docs.join(broadcast_if_small(kept), "doc_id", "left")
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    parts = []
    for rule in rules:
        there = F.col("text").rlike(rule.pattern)
        if rule.kind in queries:
            there = (F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))) & there
        parts.append(F.when(there, match_spans(F.col("text"), rule)).otherwise(none))
    return joined.select("doc_id", F.concat(*parts).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The contract's columns: counts of the base kinds, a hash of the base spans, and all spans, by start."""
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    keyed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return span_digest(found.select("doc_id", ordered.alias("spans")), [r.kind for r in rules if r.base])
