"""Personal data: base patterns with checks, and boosted trees over high-recall candidates.

Four base kinds are found by pattern and check. Beyond them, generators propose overlapping candidate spans of looser
formats (written-out e-mail addresses, phones without a country sign, national numbers, account numbers, IPv6).
Gradient-boosted trees score each candidate on its format and the words on both sides; calibrated probabilities at or
above the kind's threshold are kept, the best first where candidates overlap each other, none where they overlap a base
span. Equal probabilities go by start, then kind.

No table has labels for this. The trees are fitted to a bounded, generated sample (`SAMPLE` candidates: real and
lookalike values of each kind in sentences that speak for or against them, fixed seed); other generated rows calibrate
them and give each kind the threshold of the best F1. Hand-written cases in the tests measure precision and recall.

Spans count code points and end exclusively. Null text counts as empty; rows with a null doc_id are scanned too;
repeated rows are reported once each; an empty table gives no rows; texts of any length are scanned whole, in time that
grows with their length (a written address has at most 64 characters before its `at`, and 63 after it). Only doc_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cadenza.llm.boosting import Boosted, boost, calibrated
from cadenza.llm.shared import Taken, returns_memory, slices

BASE = ("email", "ip", "card", "phone")
#: Looser formats, each a generator of candidates.
LOOSE = {
    "written_email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?[\[(]?\b(?:at|AT)\b[\])]?\s?[\w-]{1,63}\s?[\[(]?\b(?:dot|DOT)\b[\])]?\s?[A-Za-z]{2,}", re.ASCII),
    "local_phone": re.compile(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}", re.ASCII),
    "national_id": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", re.ASCII),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII),
    "ip6": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}", re.ASCII),
}
#: The digits that a span of a kind has at least, by its pattern.
DIGITS = {"local_phone": 8, "national_id": 9, "account": 2}
KINDS = (*BASE, *LOOSE)
SAMPLE = 6_000
#: Beginnings of words that make a value near them likelier, and words that make it less likely, to be personal.
FOR = ("phone", "tel", "call", "mobile", "cell", "fax", "mail", "contact", "ssn", "social", "security", "iban", "account", "bank", "address", "reach", "dial", "text", "write", "ping", "host", "server", "transfer", "pay")
AGAINST = (
    "order", "invoice", "version", "page", "id", "no", "ref", "isbn", "item", "total", "build", "date", "part", "serial", "model", "ticket", "case", "release", "sku", "lot", "tracking", "section",
    "figure", "table", "score", "batch", "code", "license", "key", "mac", "time", "duration", "chapter", "product", "patch",
)
#: Ends of host names that a written address is taken to have.
ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "ch", "us")
#: Characters of context on either side.
BEFORE, AFTER = 48, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str, digits: int) -> list[tuple[str, int, int]]:
    """The base kinds in their order, leftmost and non-overlapping within a kind; digits: how many the text has."""
    out, before, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        before = m.end() if m else before
        at = text.find("@", max(before, at + 1))
    if digits >= 4:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    if digits >= 13:
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if digits >= 9 and "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, digits: int) -> list[tuple[str, int, int]]:
    """Loose spans of all generators; they may overlap each other and the base spans."""
    out = []
    for kind, pattern in LOOSE.items():
        if kind == "written_email":
            likely = ("dot" in text or "DOT" in text) and ("at" in text or "AT" in text)  # as the pattern implies
        elif kind == "ip6":
            likely = text.count(":") >= 4
        else:
            likely = digits >= DIGITS[kind]
        if likely:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def account_checks(span: str) -> bool:
    """Whether an account number's check digits are right: moved to the end, letters as numbers, it leaves 1 of 97."""
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - BEFORE) : start].lower(), text[end : end + AFTER].lower()
    d = _digits(span)
    lead, next_to = re.findall(r"[a-z]+", before)[-5:], re.findall(r"[a-z]+", after)[:3]
    for_, against = (lambda w: w.startswith(FOR)), (lambda w: w in AGAINST)
    groups, hexes = re.findall(r"[0-9]+", span), re.findall(r"[0-9A-Fa-f]+", span)
    tail = re.search(r"[A-Za-z]*$", span)[0].lower()
    return [
        list(LOOSE).index(kind), len(span), len(d), len(d) / max(1, len(span)), len(set(d)), span.count("-"), span.count("."), span.count(" "), span.count("("), span.count(":"),
        sum(map(for_, lead)), sum(map(against, lead)), float(bool(lead) and for_(lead[-1])), float(bool(lead) and against(lead[-1])), sum(map(for_, next_to)), sum(map(against, next_to)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in tuple("$#€£./-:_")), float(after[:1] in tuple("-./:_") and after[1:2].isalnum()),
        len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(d[:1] == "0"), float(d[:3] in ("000", "666") or d[:1] == "9"), float(d[3:5] == "00" or d[-4:] == "0000"),
        float(d[:1] in ("0", "1")), float(len(groups) > 0 and groups[0] in ("19", "20")), max(map(len, hexes), default=0), sum(len(h) == 2 for h in hexes), len(hexes),
        float(tail in ENDS), float("[" in span or "(" in span), float(kind == "account" and account_checks(span)),
    ]


def _values(rng: np.random.Generator) -> dict[str, tuple[list, list]]:
    """By kind, makers of real values and of lookalikes that are never personal."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda: "".join(pick("bcdfghlmnprstvw") + pick("aeiou") for _ in range(int(rng.integers(1, 4)))) + pick(["", "n", "r", "s"])
    area = lambda: pick("23456789") + num(2)
    gap = lambda: pick(["-", ".", " "])
    hexa = lambda: f"{int(rng.integers(0, 65536)):x}".zfill(int(rng.integers(1, 5)))

    def written() -> str:
        at, dot = pick([(" at ", " dot "), (" AT ", " DOT "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return f"{name()}{pick(['', '.' + name(), '_' + name(), num(2)])}{at}{name()}{pick(['', '-' + name()])}{dot}{pick(ENDS)}"

    def social() -> str:
        a = int(rng.integers(1, 900))
        return f"{a if a != 666 else 667:03d}-{int(rng.integers(1, 100)):02d}-{int(rng.integers(1, 10000)):04d}"

    def account() -> str:
        country, body = pick(["DE", "FR", "ES", "GB", "NL", "IT", "CH", "AT"]), pick(["", pick("ABCDNRW") * 4]) + num(int(rng.integers(12, 19)))
        digits = "".join(str(int(c, 36)) for c in body + country + "00")
        plain = f"{country}{98 - int(digits) % 97:02d}{body}"
        return " ".join(plain[k : k + 4] for k in range(0, len(plain), 4)) if rng.integers(2) else plain

    def phone() -> str:
        g = gap()
        return pick([f"({area()}) {area()}-{num(4)}", f"{area()}{g}{area()}{g}{num(4)}", f"0{pick('123456789')}{num(1)} {num(4)} {num(4)}", f"0{pick('123456789')}{num(2)} {num(3)} {num(4)}"])

    prose = ["the", "noon", "home", "station", "least", "once", "end", "page", "every", "first", "matrix", "line"]
    return {
        "written_email": ([written], [lambda: f"{pick(prose)} at {pick(prose)} dot {pick(['product', 'points', 'matrix', 'notation', name() + 'ing', 'the'])}", lambda: f"{name()} at {name()} dot {name()}ed"]),
        "local_phone": ([phone], [lambda: f"{pick(['19', '20'])}{num(2)}-{num(4)}-{num(4)}", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(2)}.{num(3)}.{num(3)}", lambda: f"000-{num(3)}-{num(4)}", lambda: f"{num(4)}-{num(4)}-{num(4)}"]),
        "national_id": ([social], [lambda: f"{pick(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}", lambda: f"{num(3)}-00-{num(4)}", lambda: f"{num(3)}-{num(2)}-0000"]),
        "account": ([account], [lambda: f"{pick(['AB', 'DE', 'QX', 'GB'])}{num(2)}{num(4)}{num(4)}{num(4)}X{num(6)}", lambda: f"{pick('ABCXYZ')}{pick('ABCXYZ')}{num(2)} {num(4)} {num(4)} {num(4)} {num(2)}"]),
        "ip6": ([lambda: ":".join(hexa() for _ in range(int(pick([8, 8, 8, 6])))), lambda: ":".join(f"{int(x):04x}" for x in rng.integers(0, 65536, 8))], [lambda: ":".join(num(2) for _ in range(int(rng.integers(5, 8)))), lambda: ":".join(f"{int(x):02x}" for x in rng.integers(0, 256, 6))]),
    }


def generated(many: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of candidates in generated sentences, whether each is personal, and its kind's number.

    A real value is personal unless the words just before it name it as something else; a lookalike never is.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    makers, kinds = _values(rng), list(LOOSE)
    plain = ["we", "saw", "it", "then", "my", "is", "was", "about", "with", "and", "there", "please", "see", "today", "use", "new", "old", "our", "for", "to", "at", "on"]
    xs, ys, ks = [], [], []
    while len(xs) < many:
        kind = pick(kinds)
        yes, spoken = bool(rng.integers(2)), rng.random()
        value = pick(makers[kind][0 if yes else 1])()
        words = [pick(plain) for _ in range(int(rng.integers(0, 5)))]
        if rng.random() < 0.25:  # another thing, of which the sentence spoke before
            words = [pick(AGAINST), str(rng.integers(0, 10**4)) + ",", *words]
        against = kind != "written_email" and spoken < (0.25 if yes else 0.3)
        lead = pick(AGAINST) if against else pick(FOR) if spoken < 0.6 else pick(plain)
        words += [lead, *([pick(["is", "was", "number", "me", "us"])] if rng.random() < 0.3 else [])]
        embedded = rng.random() < 0.06
        text = " ".join(words) + pick([" ", ": ", " ", " = ", " #"] if against else [" ", ": ", " "]) + (pick(["7-", "12.", "#", "$"]) if embedded else "")
        at = len(text)
        text += value + (pick(["-3", ".1", "/2", "_x"]) if embedded else pick([" ", ". ", ", ", "; ", "", ") "])) + " ".join(pick(plain) for _ in range(3))
        for k, a, b in candidates(text, len(_digits(text))):
            if a < at + len(value) and b > at:
                xs.append(features(text, k, a, b))
                ys.append(yes and k == kind and not against and not embedded and a >= at and b <= at + len(value) and b - a >= 0.8 * len(value))
                ks.append(list(LOOSE).index(k))
    return np.array(xs[:many], float), np.array(ys[:many], float), np.array(ks[:many])


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: tuple[float, ...]  # by loose kind

    def kept(self, x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return self.trees.probability(x) >= np.array(self.thresholds)[kinds]


def train(sample: int = SAMPLE) -> Model:
    trees = boost(*generated(sample, 1)[:2])
    x, y, kinds = generated(sample // 3, 2)
    trees = calibrated(trees, x, y)
    p, cuts = trees.probability(x), np.linspace(0.2, 0.9, 71)
    best = []
    for k in range(len(LOOSE)):
        mine, good = p[kinds == k], y[kinds == k] > 0
        f1 = np.array([2 * (good & (mine >= c)).sum() / max(1, good.sum() + (mine >= c).sum()) for c in cuts])
        best.append(float(np.median(cuts[f1 >= f1.max() - 1e-9])))
    return Model(trees, tuple(best))


def spans_of(text: str, model: Model) -> list[tuple[str, int, int]]:
    digits = len(text.encode("utf-8", "surrogatepass").translate(None, _NOT_DIGITS))
    base = base_spans(text, digits)
    if loose := candidates(text, digits):
        taken = Taken([(s, e) for _, s, e in base])
        x = np.array([features(text, *c) for c in loose], float)
        p, kept = model.trees.probability(x), model.kept(x, x[:, 0].astype(int))
        for k in sorted(np.flatnonzero(kept), key=lambda k: (-p[k], loose[k][1], loose[k])):
            if taken.add(*loose[k][1:]):
                base.append(loose[k])
    rank = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(base, key=lambda x: (rank[x[0]], x[1]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping ones the first stands."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
            at = e
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (by kind, then start) for every document, and redacted text if asked for."""
    model = train()
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>" + ", text string" * redact

    @returns_memory
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for a, b in slices(texts):
                found = [spans_of(t, model) for t in texts[a:b]]
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(), "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found]})
                yield out.assign(text=[redacted(t, f) for t, f in zip(texts[a:b], found)]) if redact else out

    return docs.select("doc_id", "text").mapInPandas(run, schema)

