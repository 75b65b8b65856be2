"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are quantised to integers, and equal ones are one point that keeps its 2k first rows by id, at most k of an id
(a query is never its own neighbour, and no result needs more). Equal queries are searched once and leave out their
own ids, which stand in that one point, at the end; an id with several vectors leaves its own rows out as it searches.
Points are dealt to tasks by their nearest of some pivots, which
farthest-first traversal picks from a bounded sample; each task builds cover trees (centre, exact covering radius,
bounded fan-out) over its points and walks them together with a cover tree over a block of queries. A pair of nodes
is pruned when

    max q.x <= cq.cx + rq |cx| + rx |cq| + rq rx

stays under the worst k-th score of the node's queries, so far or among the sampled points. Queries go in blocks of
`block`, each of which is sent to all tasks: its size, and the sample's, are bounded by parameters.

Vectors that are null, or hold a null or a non-finite component, take no part, nor do rows with a null id. Vectors of
unequal lengths are padded with zeros. Ties go to the smaller id; repeated rows are neighbours as often as
they stand there, but a query leaves out all rows of its id. A query id that is repeated has one list as in the SQL: the
k best of all pairs of one of its rows and a row of another id. An empty table gives no rows; fewer points than k give
fewer rows. Components and scores beyond 64 bits are held at the ends of that range. Only the id and vector columns are
read, so others may have any names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, broadcast_if_small


def matrix(rows, width: int = 0) -> np.ndarray:
    """Integer vectors as a matrix padded with zeros to the widest."""
    rows = [np.asarray(r, dtype=np.int64) for r in rows]
    width = max([width, *map(len, rows)], default=width)
    out = np.zeros((len(rows), width), np.int64)
    for r, x in zip(out, rows):
        r[: len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where no sum can leave its exact range, and held at the ends of
    the 64-bit range where they would leave that."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), ends.min, ends.max).astype(np.int64)


class Node:
    """A cover-tree node: a centre, its norm, the exact radius that covers all points below, and children or points."""

    __slots__ = ("centre", "norm", "radius", "children", "points")

    def __init__(self, x: np.ndarray, points: np.ndarray, at: int, away: np.ndarray, leaf: int, fan: int):
        self.centre = x[at]
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.radius = float(away.max(initial=0.0))
        self.children: list[Node] = []
        self.points = points
        if len(points) <= leaf or self.radius == 0:
            return
        near, owner, centres = away.copy(), np.zeros(len(points), np.int64), [at]
        while len(centres) < fan and near.max() > self.radius / 2:  # farthest first, until halved radii cover all
            centres.append(int(points[near.argmax()]))
            d = np.sqrt(np.maximum(0, ((x[points] - x[centres[-1]]) ** 2).sum(axis=1)))
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centres) - 1
        for k, c in enumerate(centres):
            mine = owner == k
            if mine.any():
                self.children.append(Node(x, points[mine], c, near[mine], leaf, fan))


def cover_tree(vectors: np.ndarray, leaf: int, fan: int = 16) -> Node:
    x = vectors.astype(float)
    return Node(x, np.arange(len(x)), 0, np.sqrt(((x - x[0]) ** 2).sum(axis=1)), leaf, fan)


def bound(q: Node, x: Node) -> float:
    most = float(q.centre @ x.centre) + q.radius * x.norm + x.radius * q.norm + q.radius * x.radius
    return most + 1e-9 * abs(most) + 1e-6


class Search:
    """The best `keep` points of each query of a block so far, as heaps of (score, -id, point's ids).

    own: by query, the id whose rows take no part, or None.
    """

    def __init__(self, queries: np.ndarray, floor: np.ndarray, keep: int, own: list):
        self.queries, self.keep, self.kth, self.own = queries, keep, floor.copy(), own
        self.best: list[list] = [[] for _ in queries]
        self.tree = cover_tree(queries, leaf=64) if len(queries) else None

    def leaf(self, q: Node, x: Node, vectors: np.ndarray, ids: list) -> None:
        scores = products(self.queries[q.points], vectors[x.points])
        for i, j in zip(*np.nonzero(scores >= self.kth[q.points][:, None])):
            at, point, score = q.points[i], x.points[j], int(scores[i, j])
            others = tuple(ids[point]) if self.own[at] is None else tuple(i for i in ids[point] if i != self.own[at])
            if not others:
                continue
            heap, entry = self.best[at], (score, -others[0], others)
            if len(heap) < self.keep:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.keep:
                self.kth[at] = max(self.kth[at], heap[0][0])

    def walk(self, x: Node, vectors: np.ndarray, ids: list) -> None:
        stack = [(bound(self.tree, x), self.tree, x)]
        while stack:
            most, q, x = stack.pop()
            if most < self.kth[q.points].min():
                continue
            if not q.children and not x.children:
                self.leaf(q, x, vectors, ids)
                continue
            if x.children and (not q.children or x.radius >= q.radius):
                pairs = [(bound(q, c), q, c) for c in x.children]
            else:
                pairs = [(bound(c, x), c, x) for c in q.children]
            stack += sorted(pairs, key=lambda p: p[0])  # the most promising first


def pivots_of(vectors: np.ndarray, many: int) -> np.ndarray:
    """Farthest-first traversal: a prefix of the order is a coarser net of the same points."""
    x = vectors.astype(float)
    order, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(order) < min(many, len(x)) and away.max() > 0:
        order.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[order[-1]]) ** 2).sum(axis=1))
    return vectors[order]


def top_inner_products(
    rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, sample: int = 2048, block: int = 8192, batch: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.where(fit).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"))

    of_id = Window.partitionBy("q", "id").orderBy("id")
    few = whole.withColumn("n", F.row_number().over(of_id)).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("id"))).where(F.col("n") <= 2 * k)
    points = scratch.keep(few.groupBy("q").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    asked = whole.where(F.col("id") % every == 0).groupBy("id", "q").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    own = Window.partitionBy("id")
    part = F.when(F.count("*").over(own) > 1, F.row_number().over(own.orderBy("q"))).otherwise(0)  # 0: its only vector
    asked = scratch.keep(asked.withColumn("part", part), "asked")
    shared = asked.where("part = 0").groupBy("q").agg(F.min("id").alias("key"), F.min("part").alias("part"))
    queries = scratch.keep(shared.unionByName(asked.where("part > 0").select("q", F.col("id").alias("key"), "part")), "queries")

    total = points.count()
    picked = points.select("q", "ids", F.xxhash64("q").alias("h")).orderBy("h").limit(sample).collect()  # a bounded sample
    known = matrix([r["q"] for r in picked])
    pivots = pivots_of(known, max(8, min(256, total // batch))) if total else known

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["q"], pivots.shape[1]).astype(float)
            p = np.zeros((len(pivots), x.shape[1]))
            p[:, : pivots.shape[1]] = pivots
            d = (p**2).sum(axis=1) - 2 * x @ p.T
            yield b.assign(pivot=d.argmin(axis=1).astype(np.int32))

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * batch))
    dealt = points.mapInPandas(nearest, "q array<long>, ids array<long>, pivot int").repartitionByRange(tasks, "pivot", F.xxhash64("q")).sortWithinPartitions("pivot")
    dealt = scratch.keep(dealt, "dealt")

    answers = None  # one table, to which each block's answers are added
    blocks = -(-queries.count() // block)
    for part in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("key", "part"), F.lit(blocks)) == part).collect()  # about `block` rows
        asked_for, keys = matrix([r["q"] for r in chosen], known.shape[1]), [(r["key"], r["part"]) for r in chosen]
        mine = [r["key"] if r["part"] else None for r in chosen]
        if not chosen:
            continue
        width = asked_for.shape[1]
        seeds = products(asked_for, np.pad(known, ((0, 0), (0, width - known.shape[1]))))
        for at, key in enumerate(mine):
            if key is not None:  # points of its own rows only are no lower bound
                seeds[at, [set(r["ids"]) == {key} for r in picked]] = np.iinfo(np.int64).min
        floor = np.partition(seeds, -(k + 1), axis=1)[:, -(k + 1)] if seeds.shape[1] > k else np.full(len(chosen), np.iinfo(np.int64).min)

        def search(batches: Iterator[pd.DataFrame], asked_for=asked_for, keys=keys, mine=mine, floor=floor) -> Iterator[pd.DataFrame]:
            found = Search(asked_for, floor, k + 1, mine)
            for b in batches:
                x = matrix(b["q"], asked_for.shape[1])
                if not len(x):
                    continue
                if x.shape[1] > asked_for.shape[1]:
                    x = x[:, : asked_for.shape[1]]  # components that every query has as zero
                found.walk(cover_tree(x, leaf=128), x, [list(i) for i in b["ids"]])
            out = [(*key, score, i) for key, heap in zip(keys, found.best) for score, _, ids in heap for i in ids]
            yield pd.DataFrame(out, columns=["key", "part", "score", "id"]).astype("int64")

        answers = scratch.add(dealt.select("q", "ids").mapInPandas(search, "key long, part long, score long, id long"), "answers")
    if answers is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("key", "part").orderBy(F.desc("score"), "id")
    top = answers.withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "id", "score"))), lambda s: F.struct((-s["score"]).alias("lost"), s["id"].alias("id")))
    top = scratch.keep(top.groupBy("key", "part").agg(listed.alias("top")), "top")
    one = asked.where("part = 0").join(queries.where("part = 0").select("q", "key"), "q").select("id", "key", "part", "times")
    out = one.unionByName(asked.where("part > 0").select("id", F.col("id").alias("key"), "part", "times"))
    out = out.join(broadcast_if_small(top), ["key", "part"])
    others = F.slice(F.filter("top", lambda s: s["id"] != F.col("id")), 1, k)
    out = out.select("id", "part", F.slice(F.flatten(F.transform(others, lambda s: F.array_repeat(s, F.col("times")))), 1, k).alias("top"))
    several = out.where("part > 0").groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    out = out.where("part = 0").select("id", "top").unionByName(several)
    out = out.select(F.col("id").alias("query_id"), F.posexplode("top").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.lost")).alias("score"))
