"""Hard negatives for anchors and their positives, by distributed radix selection.

Rows are quantised to integers. An anchor's positives are its best rows of the same label; each pair of an anchor and a
positive opens a window of scores, a share of the positive's, in which rows of other labels are its hard negatives. Both
are the k best rows in a window, and both are found alike:

1. every task scores its rows against the anchors by matrix products and counts, for each window, how many scores fall
   into each of 256 equal buckets between the window's ends;
2. the histograms are added up in sorted partitions, where the bucket of the k-th score is read off; the window shrinks to
   it, digit by digit, until one score is left in it or few rows lie at or over it;
3. only rows that reach that bucket are gathered, at most k of a task for each window, and ranked.

Anchors are a stated query set (rows whose id is divisible by `every`) and are held against all rows in blocks of
`block`: what the driver and a task hold is bounded by it (a block's histograms take block * positives KB), whatever the
number of rows or the size of a group of equal ones. A label may hold any share of the rows: no rows are grouped by it.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Where the id is divisible by
`relabel`, the label first becomes (label + 1) % labels. Vectors of unequal lengths are padded with zeros. Ties go to the
smaller id. A row is never its own anchor's positive or negative, nor are rows of the same id. Rows that are repeated are
found as often as they are there; of several rows with an anchor's id the smallest by label and vector is the anchor, and
equal positives open a window each. Components and scores beyond 2**61 are held there. An empty table gives no rows. Only
the id, vector and label columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, returns_memory
from cadenza.llm.topk import matrix, products

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
#: Windows whose histograms are added up together.
PART = 256
#: The end of the range of components and scores; rows at or over the k-th score's bucket that may be gathered at once.
MOST, FEW = 1 << 61, 64
#: Cells of a tile of scores; found rows that a task holds before it cuts them to k a window.
_TILE, _HELD = 1 << 21, 1 << 20


@dataclass(frozen=True)
class Windows:
    """Windows of a block of anchors: anchor by slot. A closed one has lo over hi."""

    ids: np.ndarray  # of the anchors
    labels: np.ndarray
    vectors: np.ndarray
    same: bool  # rows of the anchor's label, or of any other
    lo: np.ndarray  # (anchors, slots), lowest and highest score
    hi: np.ndarray


def tiles(batch: pd.DataFrame, w: Windows) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows, their scores with all anchors, and where they may be found."""
    step = max(16, _TILE // max(1, len(w.ids)))
    for at in range(0, len(batch), step):
        some = batch.iloc[at : at + step]
        x = matrix(some["q"], w.vectors.shape[1])
        own = np.pad(w.vectors, ((0, 0), (0, x.shape[1] - w.vectors.shape[1])))
        scores = np.clip(products(x, own), -MOST, MOST)
        alike = some["label"].to_numpy()[:, None] == w.labels[None, :]
        yield some, scores, (alike == w.same) & (some["id"].to_numpy()[:, None] != w.ids[None, :])


def shift_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits of a score below its bucket: as few as leave at most BUCKETS buckets."""
    width = np.maximum(hi - lo, 0)
    bits = np.zeros_like(width)
    for b in range(62):
        bits[width >> b > 0] = b + 1
    return np.maximum(bits - BUCKET_BITS, 0)


def kth_buckets(points: DataFrame, w: Windows, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> list:
    """(window, bucket, above, inside) of each open window (lo <= hi): the bucket of its need-th score, from the best."""
    slots, shift = lo.shape[1], shift_of(lo, hi)
    flat_need = need.ravel()

    @returns_memory
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = np.zeros((len(w.ids), slots, BUCKETS), np.int64)
        for batch in batches:
            for _, scores, fit in tiles(batch, w):
                for s in range(slots):
                    r, a = np.nonzero(fit & (scores >= lo[:, s]) & (scores <= hi[:, s]))
                    bucket = (hi[a, s] - scores[r, a]) >> shift[a, s]
                    hist[:, s] += np.bincount(a * BUCKETS + bucket, minlength=len(w.ids) * BUCKETS).reshape(-1, BUCKETS)
        flat = hist.reshape(-1, BUCKETS)
        for part in range(0, len(flat), PART):
            if flat[part : part + PART].any():
                yield pd.DataFrame({"part": [part], "counts": [flat[part : part + PART].tobytes()]})

    def pick(part: int, counts: np.ndarray) -> pd.DataFrame:
        window = np.arange(part, part + len(counts))
        reached = np.cumsum(counts, axis=1)
        enough = np.minimum(flat_need[window], reached[:, -1])
        bucket = (reached >= np.maximum(enough, 1)[:, None]).argmax(axis=1)
        inside = counts[np.arange(len(counts)), bucket]
        out = pd.DataFrame({"window": window, "bucket": bucket, "above": reached[np.arange(len(counts)), bucket] - inside, "inside": inside})
        return out[enough > 0].astype("int64")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for batch in batches:
            for part, blob in zip(batch["part"], batch["counts"]):
                counts = np.frombuffer(blob, np.int64).reshape(-1, BUCKETS)
                if part == at:
                    total = total + counts
                else:
                    if at is not None:
                        yield pick(at, total)
                    at, total = part, counts
        if at is not None:
            yield pick(at, total)

    summed = points.mapInPandas(count, "part long, counts binary").repartition("part").sortWithinPartitions("part")
    return summed.mapInPandas(add, "window long, bucket long, above long, inside long").collect()  # a row for each window of the block


def floors(points: DataFrame, w: Windows, k: int) -> np.ndarray:
    """By window, a score that all of its k best rows reach and few others do; over its highest where it has no row."""
    lo, hi = w.lo.copy(), w.hi.copy()
    out = np.where(lo <= hi, lo, hi + 1)
    need = np.full(lo.shape, k)
    while (lo <= hi).any():
        shift = shift_of(lo, hi)
        found = kth_buckets(points, w, lo, hi, need)
        still = np.zeros(lo.shape, bool)
        seen = np.zeros(lo.shape, bool)
        for r in found:
            a, s = divmod(r["window"], lo.shape[1])
            top = int(hi[a, s]) - (r["bucket"] << int(shift[a, s]))
            bottom = max(int(lo[a, s]), top - (1 << int(shift[a, s])) + 1)
            out[a, s], seen[a, s] = bottom, True
            if bottom < top and k - need[a, s] + r["above"] + r["inside"] > max(FEW, k):
                still[a, s], need[a, s] = True, need[a, s] - r["above"]
                lo[a, s], hi[a, s] = bottom, top
        out[(lo <= hi) & ~seen] = MOST + 1  # no row at all
        lo[~still], hi[~still] = 1, 0
    return out


def gathered(points: DataFrame, w: Windows, floor: np.ndarray, k: int, more: dict[str, np.ndarray]) -> DataFrame:
    """anchor, place, id, score and the columns of `more` (by window): the rows that reach a window's floor, of a task
    at most the k best for each window."""
    slots = w.lo.shape[1]

    def best(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["window", "score", "id"], ascending=[True, False, True])
        return found[found.groupby("window").cumcount() < k]

    @returns_memory
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, many = [], 0
        for batch in batches:
            for some, scores, fit in tiles(batch, w):
                ids = some["id"].to_numpy()
                for s in range(slots):
                    r, a = np.nonzero(fit & (scores >= np.maximum(floor[:, s], w.lo[:, s])) & (scores <= w.hi[:, s]))
                    held.append(pd.DataFrame({"window": a * slots + s, "score": scores[r, a], "id": ids[r]}))
                    many += len(r)
                if many > _HELD:
                    held = [best(pd.concat(held))]
                    many = 0
        if held:
            out = best(pd.concat(held))
            window = out["window"].to_numpy()
            out = out.assign(anchor=w.ids[window // slots], place=window % slots, **{c: v.ravel()[window] for c, v in more.items()})
            yield out[["anchor", "place", "id", "score", *more]].astype("int64")

    return points.mapInPandas(gather, "anchor long, place long, id long, score long" + "".join(f", {c} long" for c in more))


def k_best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, k: int = 10, positives: int = 5, every: int = 100, low: int = 30, high: int = 90, relabel: int = 7, labels: int = 10, scale: int = 256, block: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The negatives of a pair score between low and high hundredths of its positive.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    whole = whole.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if relabel:
        whole = whole.withColumn("label", F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST))
    points = scratch.keep(whole.select("id", "label", F.transform("v", held).alias("q")), "points")
    anchors = points.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "q")).alias("own"))
    anchors = scratch.keep(anchors.select("id", "own.label", "own.q"), "anchors")
    many, longest = anchors.count(), points.agg(F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()[0]
    blocks, answers = -(-many // block), None
    for part in range(blocks):
        chosen = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == part).orderBy("id").collect()  # about `block` rows
        if not chosen:
            continue
        ids, own = (np.array([r[c] for r in chosen], np.int64) for c in ("id", "label"))
        vectors = matrix([r["q"] for r in chosen])
        reach = np.minimum(np.ceil(np.sqrt((vectors.astype(float) ** 2).sum(axis=1)) * longest * (1 + 1e-9)) + 1, MOST).astype(np.int64)
        likes = Windows(ids, own, vectors, True, -reach[:, None], reach[:, None])
        best = k_best(gathered(points, likes, floors(points, likes, positives), positives, {}), positives).collect()  # a few rows for each anchor of the block
        place = {a: i for i, a in enumerate(ids.tolist())}
        lo, hi = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        positive, score = np.zeros_like(lo), np.zeros_like(lo)
        for r in best:
            at = place[r["anchor"]], r["rank"] - 1
            lo[at], hi[at] = -(-low * r["score"] // 100), high * r["score"] // 100
            positive[at], score[at] = r["id"], r["score"]
        hi[lo > hi] = lo[lo > hi] - 1
        others = Windows(ids, own, vectors, False, lo, hi)
        found = gathered(points, others, floors(points, others, k), k, {"positive": positive, "positive_score": score})
        answers = scratch.add(found, "answers")
    if answers is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return k_best(answers, k).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
