"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of all words over all documents, in `BUCKETS` hashed counts (whatever the vocabulary).
2. Benchmark items are cut into passages of `WINDOW` words; a distributed randomised SVD of their TF-IDF matrix gives
   the latent space. Each pass multiplies by the passages in parallel and sums small blocks; only the basis, bounded
   by the benchmark's vocabulary, reaches the driver.
3. Every document is read whole in windows of WINDOW words, `STRIDE` apart. A window is projected and compared by
   cosine with the benchmark passages, each held against the norm that it keeps in the latent space, so that a copy
   scores 1. Passages that keep less than `KEPT` there, as most do once the benchmark outgrows `RANK`, are looked up by
   their heavy words instead and compared by cosine over all words. The sum of the most that each word can add to any
   passage's product bounds the cosine, so windows under that bound are left out; this drops no candidate.
4. A window also holds other words, so an item shorter than it may lie under the bound however exact the copy. Such
   items are looked up by their rarest words, two of which any copy of `VERBATIM` of the item must hold, and settled by
   longest common subsequences within stretches of their own length and a quarter more. No copy of them is missed.
5. Each other candidate is settled by longest common subsequences of words around it: `verbatim` if most of the item stands
   there in order, `paraphrase` if half does and the item's answer (its `answer` column, else its last sentence) does.

The benchmark is taken in blocks of at most `block` items and `BLOCK_WORDS` distinct words (or one longer item). Each block
is one pass over the documents, whose matches are written before the next block's index is built, so what the driver and
tasks hold is bounded however long the benchmark is.

Null or empty texts and items without words match nothing. Documents with a null doc_id are searched, too, and come
out with a null. Repeated rows give repeated matches. Of equally good places of an item the first is reported. An empty
benchmark or table gives no rows. Only doc_id and text (of the benchmark: item_id, text and answer) are read, so other
columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.minhash import word_hashes
from cadenza.llm.shared import Scratch, broadcast_if_small, fresh, returns_memory, slices
from cadenza.llm.wording import lcs_length

BUCKETS, WINDOW, STRIDE, RANK = 1 << 16, 24, 8, 256
COSINE, VERBATIM, PARAPHRASE = 0.5, 0.8, 0.5
#: The norm that a unit passage must keep in the latent space to be compared there; the norm that light words, which
#: are not looked up, may have in one that is not.
KEPT, LIGHT = 0.8, 0.2
#: Bytes of a text that are hashed at a time.
_PART = 2_000_000
#: Characters that the driver takes of a benchmark at a time, and distinct words of a block.
BLOCK_CHARS, BLOCK_WORDS = 20_000_000, 50_000
_SCHEMA = "doc_id long, item_id long, cosine double, covered double, answered double, kind string, start_word long"
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def split_words(text: str) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased; other ASCII signs part words."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of a cleaned text, part by part, so that a long one takes little memory."""
    starts, values, at = [], [], 0
    while at < len(blob):
        end = len(blob) if len(blob) - at <= _PART else blob.rfind(b" ", at, at + _PART) + 1 or blob.find(b" ", at + _PART) + 1 or len(blob)
        start, value = word_hashes(blob[at:end])
        starts.append(start + at)
        values.append(value)
        at = end
    return (np.concatenate(starts), np.concatenate(values)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, one after the other, and where each text's begin and the last one's end."""
    blobs = [t.encode("utf-8", "surrogatepass").translate(_CLEAN) for t in texts]
    ends = np.cumsum([len(b) + 1 for b in blobs])
    start, value = hashes(b" ".join(blobs))
    return value, np.concatenate(([0], np.searchsorted(start, ends)))


def buckets(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(BUCKETS - 1)).astype(np.int64)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return hashes(b" ".join(words))[1]


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by bucket, counted over all documents."""

    @returns_memory
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            rows += len(texts)
            for a, b in slices(texts):
                value, edges = words_of(texts[a:b])
                once = np.unique(np.repeat(np.arange(b - a), np.diff(edges)) * BUCKETS + buckets(value))
                total += np.bincount(once % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], rows)})

    got = docs.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows
    df, rows = np.zeros(BUCKETS), 0
    for r in got:
        if r["bucket"] < 0:
            rows = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return np.log((1.0 + rows) / (1.0 + df)) + 0.05


def passages(n: int, window: int, stride: int) -> list[tuple[int, int]]:
    """(start, end) of windows over n words; the last one ends with them."""
    if n <= window:
        return [(0, n)] if n else []
    starts = [*range(0, n - window, stride), n - window]
    return [(s, s + window) for s in starts]


def randomised_basis(rows: DataFrame, width: int, rank: int, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """An orthonormal (width, rank) basis of the leading right singular space of sparse rows (ids, weights).

    A random range is sharpened by `rounds` multiplications with A'A, each one a job: tasks sum their rows' products,
    and blocks of the sums are added up by key.
    """
    rank = min(rank, width)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, rank), np.float32))[0]
    chunk = 512
    for _ in range(rounds):

        @returns_memory
        def multiply(batches: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            y = np.zeros((width, rank), np.float32)
            for b in batches:
                for ids, weights in zip(b["ids"], b["weights"]):
                    at, a = np.asarray(ids, np.int64), np.asarray(weights, np.float32)
                    np.add.at(y, at, a[:, None] * (a @ q[at])[None, :])
            yield pd.DataFrame({"part": range(0, width, chunk), "sums": [y[k : k + chunk].tobytes() for k in range(0, width, chunk)]})

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": part["part"].iloc[:1], "sums": [np.sum([np.frombuffer(s, np.float32) for s in part["sums"]], axis=0, dtype=float).astype(np.float32).tobytes()]})

        parts = rows.mapInPandas(multiply, "part long, sums binary").groupBy("part").applyInPandas(add, "part long, sums binary").collect()
        y = np.concatenate([np.frombuffer(r["sums"], np.float32).reshape(-1, rank) for r in sorted(parts, key=lambda r: r["part"])])
        q = np.linalg.qr(y)[0]
    return q


@dataclass(frozen=True)
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


@dataclass(frozen=True)
class Index:
    """A block of the benchmark in the latent space."""

    items: list[Item]
    of_word: dict[bytes, int]
    basis: np.ndarray  # (words, rank), each row times the word's weight
    latent: np.ndarray  # (passages, rank), unit rows over the norm that each keeps
    owner: np.ndarray  # the item of each of these passages
    sparse: list[tuple[np.ndarray, np.ndarray]]  # words and unit weights of the passages that keep too little
    sparse_owner: np.ndarray  # the item of each of those
    weights: np.ndarray  # by bucket


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.!?]\s+|\n", text.strip()) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


def build_index(spark, items: list[Item], weights: np.ndarray, rank: int) -> Index:
    of_word: dict[bytes, int] = {}
    for item in items:
        for w in item.words:
            of_word.setdefault(w, len(of_word))
    weight = weights[buckets(hashes_of(list(of_word)))]
    spans = [(k, s, e) for k, item in enumerate(items) for s, e in passages(len(item.words), WINDOW, WINDOW // 2)]
    sparse = []
    for k, s, e in spans:
        ids, tf = np.unique([of_word[w] for w in items[k].words[s:e]], return_counts=True)
        a = tf * weight[ids]
        sparse.append((ids.tolist(), (a / np.linalg.norm(a)).tolist()))
    rows = spark.createDataFrame(sparse, "ids array<int>, weights array<double>").repartition(max(1, len(sparse) // 2000))
    q = randomised_basis(rows, len(of_word), min(rank, len(sparse)))
    latent = np.array([np.asarray(a) @ q[np.asarray(ids)] for ids, a in sparse])
    kept = np.linalg.norm(latent, axis=1)
    owner, fit = np.array([k for k, _, _ in spans]), kept >= KEPT
    latent = latent[fit] / kept[fit, None] ** 2
    rest = [(np.asarray(sparse[p][0], np.int64), np.asarray(sparse[p][1], np.float32)) for p in np.flatnonzero(~fit)]
    return Index(items, of_word, (q * weight[:, None]).astype(np.float32), latent.astype(np.float32), owner[fit], rest, owner[~fit], weights)


class Lookup:
    """Postings of the heavy words of sparse passages: all passages whose cosine with a window reaches COSINE."""

    def __init__(self, index: Index, weight: np.ndarray):
        self.weight, self.many = weight, len(index.sparse)
        self.full = [dict(zip(ids.tolist(), a.tolist())) for ids, a in index.sparse]
        words, owners, adds = [], [], []
        self.most = np.zeros(len(weight), np.float32)  # the most that a word adds to any product
        for p, (ids, a) in enumerate(index.sparse):
            np.maximum.at(self.most, ids, a * weight[ids])
            order = np.argsort(a)
            heavy = order[np.cumsum(a[order] ** 2) > LIGHT**2]
            words.append(ids[heavy])
            owners.append(np.full(len(heavy), p))
            adds.append(a[heavy] * weight[ids[heavy]])
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        self.first = np.searchsorted(word[order], np.arange(len(weight) + 1))
        self.passage, self.add = (np.concatenate(x)[order] if words else np.zeros(0, np.int64) for x in (owners, adds))

    def __call__(self, at: np.ndarray, norm: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, passage, cosine) over windows of word places, -1 for other words."""
        out: list[tuple[int, int, float]] = []
        step = max(1, (1 << 20) // max(1, self.many))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            r, j = np.nonzero(some >= 0)
            w = some[r, j]
            n = self.first[w + 1] - self.first[w]
            hit = np.repeat(self.first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sums = np.bincount(np.repeat(r, n) * self.many + self.passage[hit], self.add[hit], len(some) * self.many).reshape(len(some), self.many)
            for r, p in zip(*np.nonzero(sums >= ((COSINE - LIGHT - 1e-4) * np.sqrt(norm[lo : lo + step]))[:, None])):
                full = self.full[p]
                cosine = sum(full[w] * self.weight[w] for w in some[r].tolist() if w in full) / np.sqrt(norm[lo + r])
                if cosine >= COSINE:
                    out.append((lo + int(r), int(p), float(cosine)))
        return out


class Short:
    """Items shorter than a window, by two of the rarest of their words, of which no copy can lack all but one."""

    def __init__(self, index: Index, weight: np.ndarray):
        self.items = index.items
        self.span = np.array([len(i.words) + len(i.words) // 4 for i in index.items], np.int64)
        self.lone = np.array([len(i.words) == 1 for i in index.items], bool)
        anchors: dict[int, list[int]] = {}
        for k, item in enumerate(index.items):
            if len(item.words) < WINDOW:
                ids = sorted((index.of_word[w] for w in item.words), key=lambda i: (-weight[i], i))
                for i in set(ids[: len(ids) - self.needed(item) + 2]):
                    anchors.setdefault(i, []).append(k)
        many = np.zeros(len(weight) + 1, np.int64)  # the last one: words that the benchmark lacks
        for i, found in anchors.items():
            many[i] = len(found)
        self.marked, self.first = many > 0, np.concatenate(([0], np.cumsum(many)))
        self.item = np.array([k for i in sorted(anchors) for k in anchors[i]], np.int64)

    @staticmethod
    def needed(item: Item) -> int:
        return max(1, int(np.ceil(VERBATIM * len(item.words) - 1e-9)))

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Items with the places from which on two of their rare words lie within one stretch."""
        p = np.flatnonzero(self.marked[ids])
        if not len(p):
            return
        n = self.first[ids[p] + 1] - self.first[ids[p]]
        item = self.item[np.repeat(self.first[ids[p]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        item, at = item[order], np.repeat(p, n)[order]
        near = self.lone[item]
        near[:-1] |= (item[1:] == item[:-1]) & (at[1:] - at[:-1] < self.span[item[1:]])
        item, at = item[near], at[near]
        for k in np.unique(item).tolist():
            yield k, at[item == k].tolist()

    def __call__(self, words: list[bytes], ids: np.ndarray, square: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
        """(item, start, covered, cosine) of the best stretch around each hit of each item."""
        for k, places in self.places(ids):
            item, span = self.items[k], int(self.span[k])
            own, need = set(item.words), self.needed(item)
            best, done = None, -1
            for p in places:
                lo, hi = max(0, p - span + 1, done), min(len(words), p + span)
                if sum(map(own.__contains__, words[lo:hi])) < need or lcs_length(item.words, words[lo:hi]) < need:
                    continue
                for start in range(lo, max(lo, min(p, hi - need)) + 1):
                    if words[start] in own and (n := lcs_length(item.words, words[start : start + span])) >= need and (best is None or n > best[0]):
                        best = n, start
                done = p + 1  # stretches up to here have been tried
                if best and best[0] == len(item.words):
                    break
            if best:
                n, start = best
                yield k, start, n / len(item.words), self.cosine(item, words[start : start + span], square[start : start + span])

    def cosine(self, item: Item, here: list[bytes], square: np.ndarray) -> float:
        """Of the item with the stretch, each word weighed by its squared weight."""
        weigh = dict(zip(here, square.tolist()))
        a, b = Counter(item.words), Counter(here)
        dot = sum(n * b[w] * weigh[w] for w, n in a.items() if w in b)
        # words of the item that are not there have about the weight of those that are
        mean = sum(weigh.values()) / len(weigh)
        norms = sum(n * n * weigh.get(w, mean) for w, n in a.items()) * sum(n * n * weigh[w] for w, n in b.items())
        return min(1.0, dot / float(np.sqrt(norms))) if norms > 0 else 0.0


class Searcher:
    def __init__(self, index: Index):
        self.index, self.square = index, index.weights**2  # by bucket
        own = hashes_of(list(index.of_word))
        self.order = np.argsort(own)
        self.own = own[self.order]
        self.likely = np.zeros(BUCKETS, bool)
        self.likely[buckets(own)] = True
        weight = index.weights[buckets(own)]
        basis, passages_t = index.basis, index.latent.T
        most = [(basis[k : k + 1000] @ passages_t).max(axis=1, initial=0) for k in range(0, len(basis), 1000)]
        self.most = np.concatenate((*most, np.zeros(1, np.float32)))  # the most that a word adds to any product; last: any other word
        self.lookup = Lookup(index, weight.astype(np.float32))
        self.most_looked_up = np.concatenate((self.lookup.most, np.zeros(1, np.float32)))
        self.short = Short(index, weight)

    def places(self, value: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The words' places in the basis, or -1."""
        ids = np.full(len(value), -1, np.int64)
        some = np.flatnonzero(self.likely[bucket])
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, value[some]), len(self.own) - 1)
            same = self.own[at] == value[some]
            ids[some[same]] = self.order[at[same]]
        return ids

    def cosines(self, at: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Cosines of windows with passages in the latent space; at: the words' places in the basis, or -1."""
        latent = np.zeros((len(at), self.index.basis.shape[1]), np.float32)
        for j in range(WINDOW):
            real = at[:, j] >= 0
            latent[real] += self.index.basis[at[real, j]]
        return (latent @ self.index.latent.T) / np.sqrt(norm)[:, None]

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, tuple]]:
        """(number of the text, match) of some texts: a match is (item_id, cosine, covered, answered, kind, start word).

        The bound on the cosine is held against the windows of all texts at once; only texts with a window that may reach
        it, or with rare words of a short item near each other, are looked at one by one.
        """
        value, edges = words_of(texts)
        bucket = buckets(value)
        ids, square = self.places(value, bucket), self.square[bucket]
        n = np.diff(edges)
        many = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        starts = edges[owner] + np.minimum(nth * STRIDE, np.maximum(n[owner] - WINDOW, 0))
        ends = np.minimum(starts + WINDOW, edges[owner + 1])
        sums = np.concatenate(([0.0], np.cumsum(square)))
        norm = sums[ends] - sums[starts]

        def able(most: np.ndarray) -> np.ndarray:
            reach = np.concatenate(([0.0], np.cumsum(most[ids], dtype=float)))
            return reach[ends] - reach[starts] >= (COSINE - 1e-4) * np.sqrt(norm)

        none = np.zeros(len(owner), bool)
        near, near_sparse = able(self.most) if len(self.index.latent) else none, able(self.most_looked_up) if self.index.sparse else none
        marked = np.zeros(len(texts), bool)
        marked[owner[near | near_sparse]] = True
        rare = np.concatenate(([0], np.cumsum(self.short.marked[ids])))
        marked |= rare[edges[1:]] > rare[edges[:-1]]
        first = np.concatenate(([0], np.cumsum(many)))
        for d in np.flatnonzero(marked):
            a, b, lo, hi = edges[d], edges[d + 1], first[d], first[d + 1]
            windows = [(starts[lo:hi][some[lo:hi]] - a, norm[lo:hi][some[lo:hi]]) for some in (near, near_sparse)]
            for found in self.matches(texts[d], ids[a:b], square[a:b], *windows):
                yield int(d), found

    def matches(self, text: str, ids: np.ndarray, square: np.ndarray, near: tuple, near_sparse: tuple) -> list[tuple]:
        """The items found in a text, the best place of each; near: starts and norms of its windows under each bound."""
        ix, n, words = self.index, len(ids), split_words(text)
        best: dict[tuple[int, int], float] = {}

        def places(starts: np.ndarray) -> np.ndarray:
            inside = starts[:, None] + np.arange(WINDOW)
            return np.where(inside < n, ids[np.minimum(inside, n - 1)], -1)

        for k in range(0, len(near[0]), 2048):
            starts, norm = (x[k : k + 2048] for x in near)
            cosine = self.cosines(places(starts), norm)
            for r, p in zip(*np.nonzero(cosine >= COSINE)):
                key = (int(ix.owner[p]), int(starts[r]))
                best[key] = max(best.get(key, 0.0), min(1.0, float(cosine[r, p])))
        for k in range(0, len(near_sparse[0]), 2048):
            starts, norm = (x[k : k + 2048] for x in near_sparse)
            for r, p, cosine in self.lookup(places(starts), norm):
                key = (int(ix.sparse_owner[p]), int(starts[r]))
                best[key] = max(best.get(key, 0.0), cosine)
        out: dict[int, tuple] = {}
        for k, start, covered, cosine in self.short(words, ids, square):
            answered = lcs_length(ix.items[k].answer, words[start : start + 2 * WINDOW]) / max(1, len(ix.items[k].answer))
            out[k] = (ix.items[k].item_id, cosine, covered, answered, "verbatim", start)
        for (k, start), cosine in best.items():
            item = ix.items[k]
            slack = max(8, len(item.words) - WINDOW // 2)
            region = words[max(0, start - slack) : start + WINDOW + slack]
            if sum(map(set(region).__contains__, item.words)) < PARAPHRASE * len(item.words):
                continue  # no subsequence can be long enough
            covered = lcs_length(item.words, region) / len(item.words)
            if covered < PARAPHRASE:
                continue
            answered = lcs_length(item.answer, region) / max(1, len(item.answer))
            kind = "verbatim" if covered >= VERBATIM else "paraphrase" if answered >= VERBATIM else None
            if kind and (k not in out or (covered, cosine, -start) > (out[k][2], out[k][1], -out[k][5])):
                out[k] = (item.item_id, cosine, covered, answered, kind, start)
        return [out[k] for k in sorted(out)]


def item_blocks(benchmark: DataFrame, block: int) -> Iterator[list[Item]]:
    """Items with words, in blocks of at most so many and of BLOCK_WORDS distinct words."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    wanted = benchmark.select("item_id", "text", answer.alias("answer")).where("text is not null")
    many, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-many // block), -(-chars // BLOCK_CHARS))
    for k in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about `block` items
        items, known = [], set()
        for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])):
            if not (words := split_words(r["text"])):
                continue
            if items and (len(items) >= block or len(known) + len(set(words) - known) > BLOCK_WORDS):
                yield items
                items, known = [], set()
            items.append(Item(r["item_id"], words, split_words(r["answer"] or last_sentence(r["text"]))))
            known.update(words)
        if items:
            yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, block: int = 5_000) -> DataFrame:
    """doc_id, item_id, cosine, covered, answered, kind, start_word: one row for each item that a document holds."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    weights, here, found, scratch = None, None, None, Scratch(spark, "matches")
    for items in item_blocks(benchmark, block):
        if here is not None:
            found = scratch.add(here, "found")  # and the index of the block before is let go
        weights = word_weights(docs) if weights is None else weights
        index = build_index(spark, items, weights, rank)

        @returns_memory
        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            find = Searcher(index)
            for batch in batches:
                texts = batch["text"].where(batch["text"].notna(), "").tolist()
                for a, b in slices(texts):
                    ids = batch["doc_id"].iloc[a:b].tolist()
                    rows = [(ids[d], *hit) for d, hit in find(texts[a:b])]
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
                    yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        here = docs.mapInPandas(search, _SCHEMA)
    if here is None:
        return spark.createDataFrame([], _SCHEMA)
    return here if found is None else scratch.add(here, "found")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; works row by row, so ids may be null or repeated."""
    scratch = Scratch(docs.sparkSession, "leaks")
    by_text = docs.select(F.xxhash64("text", F.length("text")).alias("doc_id"), "text")
    (text_,) = fresh(docs.columns, "text_hash")
    leaked = scratch.keep(find_leaks(by_text, benchmark).select(F.col("doc_id").alias(text_)).distinct(), "leaked")
    return docs.withColumn(text_, F.xxhash64("text", F.length("text"))).join(broadcast_if_small(leaked), text_, "left_anti").drop(text_)
