"""Toxicity scores of documents by a convolutional text classifier, trained in NumPy.

A word's embedding is the sum of hashed rows: of the whole word and of its beginnings and its end, so that unseen forms of
a known stem are known, too. Filters of several widths run over the embedded words, each filter's maximum over the whole
text is pooled, and a linear layer turns the pooled values into a logit; its weights are never negative, so that no clean
words make up for toxic ones. Rows of the embedding that training never touched
are zero: unknown words are neutral.

Training sees every labelled row, whole. One in four, by a hash of the doc_id, is kept from the fit. About `PART` rows,
a third of them toxic, give a first network, in several passes; from it every part goes on over its own rows once, on its own, and the
changes are averaged, an embedding row's by how often a part changed it. Sums are of whole numbers, so they do not depend on
the order of tasks. Up to `PART` labelled rows all give the first one and there is no second step. On the rows kept from the fit, all of them, the logits (to
1/`STEPS`) are calibrated by language: texts are put into `languages` groups by their letters alone (spherical k-means, begun
on the first part, its last round over all rows; the lang column is not read). Each group with enough rows of both classes
gets the threshold of fewest errors, the classes weighed as they are among all labelled rows; the others get the threshold of
all. The score maps the threshold to `cut`.

Every document is scored on its whole text, long ones piece by piece with overlapping windows. Null and empty texts are
scored as empty ones. With no labelled row of either class every score is just under `cut`: nothing is toxic. Labels that
are null are not used; a document with several labels counts with the largest; of several texts of one labelled id the
smallest is learned from. Documents with a null doc_id are scored, never learned from. Repeated rows are scored alike; a
score equal to `cut` is toxic. An empty table gives no rows. Other columns pass; input columns named score, held_out or
predicted are replaced by toxicity_scores and pass in drop_toxic.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.quality import learnable
from cadenza.llm.shared import Scratch, slices

BUCKETS, WIDTH = 1 << 17, 16
FILTERS, FILTER_WIDTHS = 12, (1, 2, 3)
PIECES = 5
#: Labelled rows of a part, parts at most; steps of a logit that is calibrated, and its bound; the unit of sums over parts.
PART, PARTS, STEPS, FAR, UNIT = 6_000, 64, 256, 64, 1 << 30
#: Hashed rows that fewer texts of the sample use stay nought: what one text alone shows is no evidence.
RARE = 2
#: Words of a text that are scored at a time, and words that a task remembers.
_PIECE_WORDS, _REMEMBERED = 100_000, 60_000
_SPLIT = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of letters and digits."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def hashed(word: bytes) -> tuple[int, ...]:
    """Rows of a word: itself, its beginnings of four to six bytes, and its end."""
    return tuple(zlib.crc32(x) % BUCKETS for x in (b"w" + word, b"4" + word[:4], b"5" + word[:5], b"6" + word[:6], b"e" + word[-5:]))


class Vocabulary:
    """Numbers of words from 1 (0: no word) and their hashed rows; forgets when it holds too many."""

    def __init__(self, most: int | None = None):
        self.most, self.of, self.rows = most, {}, [(0,) * PIECES]

    def __call__(self, texts: Iterable[str]) -> list[np.ndarray]:
        if self.most and len(self.of) > self.most:
            self.of, self.rows = {}, [(0,) * PIECES]
        out = []
        for text in texts:
            words = words_of(text)
            for w in set(words):
                if w not in self.of:
                    self.of[w] = len(self.rows)
                    self.rows.append(hashed(w))
            seq = np.fromiter(map(self.of.__getitem__, words), np.int32, len(words))
            out.append(np.pad(seq, (0, max(0, max(FILTER_WIDTHS) - len(seq)))))
        return out


def embedded(table: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Embeddings of words, of which number 0 is nought."""
    out = table[rows].sum(axis=1)
    out[numbers == 0] = 0
    return out


@dataclass
class Net:
    table: np.ndarray  # (BUCKETS, WIDTH)
    filters: list[np.ndarray]  # by width: (width, WIDTH, FILTERS)
    out: np.ndarray  # (len(FILTER_WIDTHS) * FILTERS,)
    bias: float

    def maps(self, seq: np.ndarray, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of a sequence of words: each width's filter values by place; the distinct words, their embeddings, their places."""
        own, at = np.unique(seq, return_inverse=True)
        e = embedded(self.table, rows[own], own)
        values = []
        for w, f in zip(FILTER_WIDTHS, self.filters):
            n = len(seq) - w + 1
            values.append(sum((e @ f[j])[at[j : j + n]] for j in range(w)))
        return values, own, e, at

    def logits(self, docs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        pooled = np.zeros((len(docs), len(self.out)), np.float32)
        for k in (k for k, d in enumerate(docs) if len(d) > _PIECE_WORDS):
            pooled[k] = self.pooled_one(docs[k], rows)
        short = [k for k, d in enumerate(docs) if len(d) <= _PIECE_WORDS]
        if short:
            ends = np.cumsum([len(docs[k]) for k in short])
            starts = ends - [len(docs[k]) for k in short]
            best = []
            for w, values in zip(FILTER_WIDTHS, self.maps(np.concatenate([docs[k] for k in short]), rows)[0]):
                edges = np.stack((starts, ends - w + 1), axis=1).ravel()  # windows within one document
                best.append(np.maximum.reduceat(values, edges[:-1] if edges[-1] == len(values) else edges)[::2])
            pooled[short] = np.concatenate(best, axis=1)
        return pooled @ self.out + self.bias

    def pooled_one(self, seq: np.ndarray, rows: np.ndarray) -> np.ndarray:
        over = max(FILTER_WIDTHS) - 1
        best = np.full(len(self.out), -np.inf, np.float32)
        for a in range(0, len(seq) - over, _PIECE_WORDS):
            values = self.maps(seq[a : a + _PIECE_WORDS + over], rows)[0]
            best = np.maximum(best, np.concatenate([v.max(axis=0) for v in values]))
        return best

    def places(self, docs: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each document the pooled values and, by width, where in it each filter has its maximum; long ones by pieces."""
        over = max(FILTER_WIDTHS) - 1
        values, _, _, _ = self.maps(np.concatenate([d[: _PIECE_WORDS + over] for d in docs]), rows)
        ends = np.cumsum([min(len(d), _PIECE_WORDS + over) for d in docs])
        starts = np.concatenate(([0], ends[:-1]))
        at = [np.stack([v[s : t - w + 1].argmax(axis=0) for s, t in zip(starts, ends)]) for w, v in zip(FILTER_WIDTHS, values)]
        best = [np.take_along_axis(v, p + starts[:, None], axis=0) for v, p in zip(values, at)]
        for k, d in enumerate(docs):
            for a in range(_PIECE_WORDS, len(d) - over, _PIECE_WORDS):
                for v, p, most in zip(self.maps(d[a : a + _PIECE_WORDS + over], rows)[0], at, best):
                    top = v.argmax(axis=0)
                    more = v[top, np.arange(FILTERS)] > most[k]
                    p[k] = np.where(more, a + top, p[k])
                    most[k] = np.where(more, v[top, np.arange(FILTERS)], most[k])
        return np.concatenate(best, axis=1), at


class Training:
    """A network and Adagrad's sums; a maximum passes its gradient to its place alone."""

    def __init__(self, net: Net, common: np.ndarray, speed: float):
        self.net, self.common, self.speed = net, common, speed
        self.seen, self.seen_f, self.seen_out, self.seen_bias = np.zeros_like(net.table), [np.zeros_like(f) for f in net.filters], np.zeros_like(net.out), 0.0

    def step(self, docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One batch; the rows of the embedding that it would change, common or not."""
        net, speed = self.net, self.speed
        pooled, places = net.places(docs, rows)
        wrong = ((1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30))) - toxic) * weight / len(docs)).astype(np.float32)
        words = [np.stack([np.stack([d[q + j] for d, q in zip(docs, p)]) for j in range(w)]) for w, p in zip(FILTER_WIDTHS, places)]
        own, at = np.unique(np.concatenate([x.ravel() for x in words]), return_inverse=True)
        e = embedded(net.table, rows[own], own)
        slope_e = np.zeros_like(e)
        back = wrong[:, None] * net.out[None, :]
        begin = 0
        for k, w in enumerate(FILTER_WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS].ravel()
            f = np.tile(np.arange(FILTERS), len(docs))
            slope = np.zeros_like(net.filters[k])
            for j in range(w):
                word = at[begin : begin + len(f)]
                begin += len(f)
                np.add.at(slope_e, word, g[:, None] * net.filters[k][j].T[f])
                np.add.at(slope[j].T, f, g[:, None] * e[word])
            self.seen_f[k] += slope**2
            net.filters[k] -= speed * slope / (np.sqrt(self.seen_f[k]) + 1e-3)
        slope = pooled.T @ wrong + 1e-4 * net.out
        self.seen_out += slope**2
        net.out = np.maximum(0, net.out - speed * slope / (np.sqrt(self.seen_out) + 1e-3))
        self.seen_bias += float(wrong.sum()) ** 2
        net.bias -= speed * float(wrong.sum()) / (self.seen_bias**0.5 + 1e-3)
        hit = np.flatnonzero(slope_e.any(axis=1) & (own > 0))
        touched, place = np.unique(rows[own[hit]].ravel(), return_inverse=True)
        slope = np.zeros((len(touched), WIDTH), np.float32)
        np.add.at(slope, place.ravel(), np.repeat(slope_e[hit], PIECES, axis=0))
        slope[~self.common[touched]] = 0
        self.seen[touched] += slope**2
        net.table[touched] -= speed * slope / (np.sqrt(self.seen[touched]) + 1e-3)
        return touched


def class_weights(toxic: int, clean: int) -> tuple[float, float]:
    """Of a clean and of a toxic row, so that the classes weigh alike."""
    return 0.5 * (toxic + clean) / max(1, clean), 0.5 * (toxic + clean) / max(1, toxic)


def begun(docs: list[np.ndarray], toxic: np.ndarray, rows: np.ndarray, epochs: int | None = None, batch: int = 16, speed: float = 0.15, seed: int = 5) -> Training:
    """Logistic loss, classes weighed alike, by Adagrad on small batches."""
    epochs = epochs or max(8, min(24, 24_000 // max(1, len(docs))))
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32), [rng.normal(0, 0.4, (w, WIDTH, FILTERS)).astype(np.float32) for w in FILTER_WIDTHS],
        np.abs(rng.normal(0, 0.4, len(FILTER_WIDTHS) * FILTERS)).astype(np.float32), 0.0,
    )
    many = np.bincount(np.concatenate([np.unique(rows[np.unique(d[d > 0])]) for d in docs]), minlength=BUCKETS)
    training = Training(net, many >= RARE, speed)
    net.table[~training.common] = 0
    weight = np.array(class_weights(int(toxic.sum()), int((~toxic).sum())))[toxic.astype(int)]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            mine = order[lo : lo + batch]
            training.step([docs[k] for k in mine], toxic[mine], weight[mine], rows)
    return training


def train_net(docs: list[np.ndarray], toxic: np.ndarray, rows: np.ndarray, epochs: int | None = None) -> Net:
    return begun(docs, toxic, rows, epochs).net


def letters(text: str) -> np.ndarray:
    """The mix of a text's bytes, lower-cased, as a unit vector."""
    counts = np.bincount(np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8), minlength=256)[97:]
    x = np.sqrt(counts)
    return x / max(1e-9, np.sqrt((x**2).sum()))


def letter_groups(x: np.ndarray, many: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, from a farthest-first start."""
    centres = [x.mean(axis=0)]
    while len(centres) < many:
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        c = np.array([x[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(many)])
        c /= np.maximum(1e-9, np.sqrt((c**2).sum(axis=1)))[:, None]
    return c


def parting(logit: np.ndarray, toxic: np.ndarray, share: float, many: np.ndarray | None = None) -> float:
    """The middle of the gap of fewest errors where `share` of all texts are toxic; the widest of equally good gaps. `many`
    texts have a logit, one if not given."""
    order = np.argsort(logit, kind="stable")
    many = np.ones(len(logit), np.int64) if many is None else many
    z, bad, good = logit[order], (many * toxic)[order], (many * ~toxic)[order]
    under, over = np.cumsum(bad)[:-1] / bad.sum(), 1 - np.cumsum(good)[:-1] / good.sum()
    gap = z[1:] - z[:-1]
    wrong = np.where(gap > 0, share * under + (1 - share) * over, np.inf)
    if not len(wrong) or not np.isfinite(wrong.min()):
        return float(np.average(z, weights=bad + good))
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = least[gap[least].argmax()]
    return float(z[k] + z[k + 1]) / 2


@dataclass(frozen=True)
class Model:
    net: Net
    centres: np.ndarray
    thresholds: np.ndarray  # by group
    scale: float
    cut: float

    def scores(self, texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
        docs = vocabulary(texts)
        z = self.net.logits(docs, np.array(vocabulary.rows))
        group = (np.array([letters(t) for t in texts]) @ self.centres.T).argmax(axis=1)
        z = np.clip((z - self.thresholds[group]) * self.scale, -30, 30) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-z))


def fit(texts: list[str], toxic: np.ndarray, share: float, languages: int = 4, cut: float = 0.5) -> Model | None:
    """A model of labelled texts, of which a share is toxic where they come from; None if a class is missing."""
    if len(set(toxic.tolist())) < 2:
        return None
    apart = np.zeros(len(toxic), bool)
    for c in (True, False):
        apart[np.flatnonzero(toxic == c)[3::4]] = True
    held = apart if len(set(toxic[apart].tolist())) == 2 else np.ones(len(toxic), bool)
    vocabulary = Vocabulary()
    docs = vocabulary(texts)
    rows = np.array(vocabulary.rows)
    net = train_net([docs[k] for k in np.flatnonzero(~apart)], toxic[~apart], rows)
    x = np.array([letters(t) for t in texts])
    centres = letter_groups(x, languages)
    held_at = np.flatnonzero(held)
    z = np.concatenate([net.logits(docs[k : k + 1], rows) for k in held_at])
    group = (x[held] @ centres.T).argmax(axis=1)
    return calibrated(net, centres, z, group, toxic[held], np.ones(len(z), np.int64), share, cut)


def calibrated(net: Net, centres: np.ndarray, z: np.ndarray, group: np.ndarray, bad: np.ndarray, many: np.ndarray, share: float, cut: float) -> Model:
    """`many` rows kept from the fit have a logit, group and class."""
    thresholds = np.full(len(centres), parting(z, bad, share, many))
    for g in range(len(centres)):
        mine = group == g
        if min(many[mine & bad].sum(), many[mine & ~bad].sum()) >= 20:
            thresholds[g] = parting(z[mine], bad[mine], share, many[mine])
    apart_by = abs(float(np.average(z[bad], weights=many[bad])) - float(np.average(z[~bad], weights=many[~bad])))
    return Model(net, centres, thresholds, 8 / max(1e-6, apart_by), cut)


_LETTERS = 256 - 97
_SUMS = [f"s{k}" for k in range(WIDTH)]


def _packed(net: Net) -> np.ndarray:
    """Filters, output weights and bias as rows of WIDTH numbers."""
    flat = np.concatenate([*(f.ravel() for f in net.filters), net.out, [net.bias]]).astype(np.float64)
    return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)


def _unpacked(table: np.ndarray, packed: np.ndarray) -> Net:
    flat, at, filters = packed.ravel(), 0, []
    for w in FILTER_WIDTHS:
        n = w * WIDTH * FILTERS
        filters.append(flat[at : at + n].reshape(w, WIDTH, FILTERS).astype(np.float32))
        at += n
    n = len(FILTER_WIDTHS) * FILTERS
    return Net(table, filters, np.maximum(0, flat[at : at + n]).astype(np.float32), float(flat[at + n]))


def _first(languages: int):
    """mapInPandas: the first network and the centres of its part's letters, as one pickled row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, docs, toxic, apart, x = Vocabulary(), [], [], [], []
        for b in batches:
            docs += vocabulary(b["text"])
            x += [letters(t) for t in b["text"]]
            toxic, apart = toxic + b["toxic"].tolist(), apart + b["apart"].tolist()
        toxic, fitted = np.array(toxic, bool), ~np.array(apart, bool)
        if len(docs) and len(set(toxic[fitted].tolist())) < 2:
            fitted[:] = True
        if len(set(toxic.tolist())) == 2:
            training = begun([docs[k] for k in np.flatnonzero(fitted)], toxic[fitted], np.array(vocabulary.rows))
            yield pd.DataFrame({"made": [pickle.dumps((training, letter_groups(np.array(x), languages)))]})

    return run


def _going_on(training: Training, centres: np.ndarray, weights: tuple[float, float], batch: int = 16):
    """mapInPandas: what one pass over a part's rows changes, as sums of whole numbers: of the embedding's rows by their
    place, of the other weights after these (`many` batches each), of the letters of each group at last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        old_table, old = training.net.table.copy(), _packed(training.net)
        vocabulary, many = Vocabulary(_REMEMBERED), np.zeros(BUCKETS, np.int64)
        sums, texts_of, steps = np.zeros((len(centres), _LETTERS)), np.zeros(len(centres), np.int64), 0
        for frame in batches:
            for a, b in slices(frame["text"].tolist()):
                part = frame.iloc[a:b]
                x = np.array([letters(t) for t in part["text"]])
                group = (x @ centres.T).argmax(axis=1)
                np.add.at(sums, group, x)
                texts_of += np.bincount(group, minlength=len(centres))
                part = part[~part["apart"]]
                docs, toxic = vocabulary(part["text"]), part["toxic"].to_numpy(bool)
                rows = np.array(vocabulary.rows)
                for lo in range(0, len(docs), batch):
                    bad = toxic[lo : lo + batch]
                    touched = training.step(docs[lo : lo + batch], bad, np.array(weights)[bad.astype(int)], rows)
                    many[touched] += 1
                    training.common[touched] |= many[touched] >= RARE  # what one batch alone shows is no evidence
                    steps += 1
        changed = np.flatnonzero(many * training.common)
        deltas = [(changed, many[changed], training.net.table[changed] - old_table[changed]), (BUCKETS + np.arange(len(old)), np.full(len(old), steps), _packed(training.net) - old)]
        for at, n, delta in deltas:
            whole = np.rint(delta.astype(np.float64) * n[:, None] * UNIT).astype(np.int64)
            yield pd.DataFrame({"at": at, "many": n} | dict(zip(_SUMS, whole.T)))
        padded = np.pad(np.rint(sums * UNIT).astype(np.int64), ((0, 0), (0, -_LETTERS % WIDTH))).reshape(-1, WIDTH)
        at = BUCKETS + len(old) + np.arange(len(padded))
        yield pd.DataFrame({"at": at, "many": np.repeat(texts_of, len(padded) // len(centres))} | dict(zip(_SUMS, padded.T)))

    return run


def _logits(net: Net, centres: np.ndarray):
    """mapInPandas: group, logit in STEPS, class and how many rows have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(_REMEMBERED)
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in slices(texts):
                docs = vocabulary(texts[a:b])
                z = np.clip(net.logits(docs, np.array(vocabulary.rows)), -FAR, FAR)
                group = (np.array([letters(t) for t in texts[a:b]]) @ centres.T).argmax(axis=1)
                yield pd.DataFrame({"group": group, "z": np.rint(z * STEPS).astype(np.int64), "toxic": frame["toxic"].to_numpy(bool)[a:b]})

    return run


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.5, languages: int = 4) -> Model | None:
    """A model from all labelled rows; None if a class is missing."""
    usable = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") >= 1).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(usable, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    place = F.xxhash64(F.lit("part"), "doc_id")
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(rows.withColumns({"apart": F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, "place": place}), "labelled")
    counts = {(r["toxic"], r["apart"]): r["count"] for r in rows.groupBy("toxic", "apart").count().collect()}
    total = {c: counts.get((c, False), 0) + counts.get((c, True), 0) for c in (True, False)}
    if not all(total.values()):
        return None
    many = sum(total.values())
    parts = min(PARTS, math.ceil(many / PART))
    if not all(counts.get((c, False)) for c in (True, False)):
        rows = rows.withColumn("apart", F.lit(False))
    held = rows.where("apart") if all(counts.get((c, True)) for c in (True, False)) and all(counts.get((c, False)) for c in (True, False)) else rows
    thin = {c: max(1, total[c] // n) if parts > 1 else 1 for c, n in ((True, PART // 3), (False, PART - PART // 3))}
    some = rows.where(F.pmod("place", F.when(F.col("toxic"), thin[True]).otherwise(thin[False])) == 0)
    some = some.repartition(1).sortWithinPartitions("place", "doc_id").mapInPandas(_first(languages), "made binary").collect()
    if not some:
        return None
    training, centres = pickle.loads(some[0]["made"])
    net = training.net
    if parts > 1:
        fitted = [counts.get((c, False), 0) for c in (True, False)]
        shape = "at long, many long, " + ", ".join(f"{s} long" for s in _SUMS)
        changes = rows.repartition(parts, "doc_id").sortWithinPartitions("place", "doc_id").mapInPandas(_going_on(training, centres, class_weights(*fitted)), shape)
        sums = changes.groupBy("at").agg(F.sum("many"), *(F.sum(s) for s in _SUMS)).toPandas().sort_values("at").to_numpy(np.int64)
        mean = np.zeros((int(sums[:, 0].max()) + 1, WIDTH))
        mean[sums[:, 0]] = sums[:, 2:] / UNIT / np.maximum(1, sums[:, 1])[:, None]
        packed = _packed(net)
        end = BUCKETS + len(packed)
        net = _unpacked(net.table + mean[:BUCKETS].astype(np.float32), packed + mean[BUCKETS:end])
        new = mean[end:].reshape(languages, -1)[:, :_LETTERS]
        length = np.sqrt((new**2).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, new / np.maximum(1e-9, length), centres)
    found = held.mapInPandas(_logits(net, centres), "group long, z long, toxic boolean").groupBy("group", "z", "toxic").count().toPandas().sort_values(["group", "z", "toxic"])
    scratch.drop()
    return calibrated(net, centres, found["z"].to_numpy() / STEPS, found["group"].to_numpy(), found["toxic"].to_numpy(bool), found["count"].to_numpy(), total[True] / many, cut)


def score_column(model: Model | None, text: Column, cut: float = 0.5) -> Column:
    if model is None:
        return F.lit(cut * 0.999)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(_REMEMBERED)
        for batch in batches:
            texts = batch.where(batch.notna(), "").tolist()
            parts = [model.scores(texts[a:b], vocabulary) for a, b in slices(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return F.pandas_udf(score, "double")(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """docs with held_out, score and predicted (1 where score >= cut)."""
    scored = docs.withColumn("score", score_column(train(docs, labels, cut), F.col("text"), cut))
    return scored.withColumn("held_out", ~learnable(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under cut, with their own columns."""
    return docs.where(score_column(train(docs, labels, cut), F.col("text"), cut) < cut)
