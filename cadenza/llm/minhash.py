"""Near-duplicate grouping: fast similarity sketches, banding, exact verification, connected components.

A document's set holds the 64-bit hashes of its distinct word n-grams (words: runs of anything but ASCII white
space, A-Z lower-cased). Fast similarity sketching places all elements into bins in rounds; the first rounds place
each element in a hashed bin, the last ones place every element in one given bin, so all coordinates fill. Bands of
coordinates give buckets. Nothing is paired within a bucket wholesale:

1. documents with equal sets are one class, of which the smallest doc_id stands for all;
2. in each bucket the member that shares most bucket places is the leader, and every other member is verified
   against it on full sets (at most one pair per bucket place);
3. components of the verified links are found; only where a bucket's members are still in different components are
   they then held against each other: those apart from the leader's component with it, and among themselves, as long as
   no more than `CROWD` of them meet. Where more do (pages of one template, say), they are joined on their rare shingles:
   with shingles ordered by how many of these members have them, two sets can reach the threshold only if they share one
   among the first of either, at places that leave enough behind them. That prefix test is exact, and what all pages
   share never makes a pair. Bitmaps of the hashed shingles exclude more pairs exactly; the rest are verified. No bucket
   or list is capped.

Results are exact up to the banding: a pair at the threshold of 0.8 shares no bucket with probability
(1 - 0.8**5)**32 < 4e-6.

Null text, empty text and text without words give an empty set: n_shingles 0, linked with nothing. A text with
fewer words than n has one shingle, the whole sequence. Rows with a null doc_id take no part. Repeated rows of one
doc_id are taken as one document each and come out as often as they came in; where they have different texts, a link of
any of them links that doc_id. Of equal documents the smallest doc_id stands for all. An empty table gives no rows. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, broadcast_if_small, returns_memory, slices

BANDS, ROWS = 32, 5
#: Longs of a set's signature, a bitmap of its hashed shingles.
SIGNATURE = 16
#: Members apart from a bucket's, or a component's, leader up to which each of them meets all others.
CROWD = 200
#: Frequent shingles of crowds, at most so many, whose places tasks work out by themselves.
OFTEN = 100_000
#: A class with more than this share of all documents is joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE = 1 / 2000
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.uint64, np.uint64]:
    base = 0x5851F42D4C957F2D | 1
    return np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words of an ASCII-lower-cased UTF-8 text."""
    b = np.frombuffer(blob, dtype=np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    base, inverse = _powers()
    up = np.cumprod(np.full(len(b) + 1, base, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(b.astype(np.uint64) + _STEP) * up[:-1])))
    down = np.cumprod(np.full(len(b) + 1, inverse, dtype=np.uint64))
    return start, _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of all texts' distinct n-word shingles, sorted by row, then hash."""
    blobs = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(x) + 1 for x in blobs])
    start, h = word_hashes(b"\n".join(blobs) + b"\n")
    row = np.searchsorted(ends, start, side="right")
    if not len(h):
        return row.astype(np.int64), h
    first = np.searchsorted(row, np.arange(len(texts)))
    words = np.diff(np.append(first, len(row)))
    k = np.arange(len(h)) - first[row]
    value = np.zeros(len(h), np.uint64)
    for j in range(n):  # an order-sensitive combination of up to n words
        at = np.minimum(np.arange(len(h)) + j, len(h) - 1)
        value = np.where(k + j < words[row], _mix(value * _STEP + h[at]), value)
    real = (k <= words[row] - n) | (k == 0)
    row, value = row[real].astype(np.int64), value[real]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def sketches(row: np.ndarray, value: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Fast similarity sketches of all sets, as (rows, size) integers; sets must not be empty.

    Coordinate b is the least (round, hash) over the elements placed in bin b. Rounds 0..size-1 place each element
    in a hashed bin, round size+b places all of them in bin b; a set leaves when its bins are full.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * size, top, np.uint64)
    live_row, live = row, value
    for i in range(2 * size):
        h = _mix(live + np.uint64((i + 1) * int(_STEP) & int(top)))
        place = (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64) if i < size else np.full(len(h), i - size)
        np.minimum.at(out, live_row * size + place, (np.uint64(i) << np.uint64(48)) | (_mix(h) >> np.uint64(16)))
        full = ~(out.reshape(rows, size) == top).any(axis=1)
        stay = ~full[live_row]
        if not stay.all():
            live_row, live = live_row[stay], live[stay]
        if not len(live):
            break
    return out.reshape(rows, size)


def band_keys(sketch: np.ndarray, bands: int, per: int) -> np.ndarray:
    """(rows, bands) keys; equal where all coordinates of a band, and the band, are equal."""
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sketch), bands)).copy()
    parts = sketch.reshape(len(sketch), bands, per)
    for j in range(per):
        keys = _mix(keys * _MIX1 + parts[:, :, j])
    return keys.view(np.int64)


def _sketch_rows(n: int, bands: int, per: int):
    @returns_memory
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for a, b in slices(texts):
                row, value = shingle_sets(texts[a:b], n)
                count = np.bincount(row, minlength=b - a)
                has = np.flatnonzero(count)
                number = np.cumsum(count > 0) - 1
                keys = band_keys(sketches(number[row], value, len(has), bands * per), bands, per) if len(has) else np.zeros((0, bands), np.int64)
                sums = [np.zeros(b - a, np.uint64) for _ in range(2)]
                for k, s in enumerate(sums):  # order-free fingerprints of the whole set
                    np.add.at(s, row, _mix(value + np.uint64((77 + k) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "n_shingles": count.astype(np.int64),
                    "fp1": sums[0].view(np.int64), "fp2": sums[1].view(np.int64),
                    "bands": [keys[number[i]] if count[i] else np.zeros(0, np.int64) for i in range(b - a)],
                })

    return run


def _set_rows(n: int):
    @returns_memory
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for a, b in slices(texts):
                row, value = shingle_sets(texts[a:b], n)
                at = np.searchsorted(row, np.arange(b - a + 1))
                bits = np.zeros((b - a, 64 * SIGNATURE), bool)
                bits[row, (value % np.uint64(64 * SIGNATURE)).astype(np.int64)] = True
                signature = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                shingles = [value[i:j].view(np.int64) for i, j in zip(at, at[1:])]
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(), "shingles": shingles, "signature": list(signature)})

    return run


def _sets(docs: DataFrame, ids: DataFrame, n: int, scratch: Scratch, tag: str) -> DataFrame:
    """(id, shingles, signature) of the documents named in ids (id)."""
    wanted = broadcast_if_small(scratch.keep(ids.distinct(), f"wanted-{tag}"))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi").mapInPandas(_set_rows(n), "id long, shingles array<long>, signature array<long>")
    return scratch.keep(rows, f"sets-{tag}")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """pairs (a, b) with the shared and joint sizes of their full sets, and whether they are linked."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    out = pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("shared"), (F.size("sa") + F.size("sb") - both).alias("joint"))
    return scratch.keep(out.withColumn("linked", F.col("shared") * 100 >= F.col("joint") * percent), f"verified-{tag}")


def rare_shingle_pairs(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of members (rep, n, component) of different components whose sets may reach the threshold.

    Exact prefix filter. Shingles are ordered by how many members have them, then by hash. Of two linked sets the smaller
    one has a joint shingle among its first n - ceil(2t / (1 + t) n) + 1, the larger one among its first
    n - ceil(t n) + 1, and behind the place of the first such shingle either has enough left. Shingles of one component
    only are left out; per shingle, members of the largest component are not joined with each other.
    """
    size = members.groupBy("component").agg(F.count("*").alias("size"))
    own = scratch.keep(members.join(size, "component"), "crowd")
    owned = sets.select(F.col("id").alias("rep"), "shingles").join(own, "rep")
    tokens = owned.select("component", "size", F.explode("shingles").alias("s"))
    stats = tokens.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max(F.struct("size", "component"))["component"].alias("major"), F.max("component").alias("high"))
    stats = scratch.keep(stats.where("df > 1"), "stats")  # others are first in any order and join with nothing
    often = max(1, (own.agg(F.sum("n")).first()[0] or 0) // OFTEN)
    hot = sorted((r["s"], r["df"]) for r in stats.where(F.col("df") > often).select("s", "df").collect())  # at most OFTEN
    hot_s, hot_df = np.array([s for s, _ in hot], np.int64), np.array([d for _, d in hot], np.int64)

    @returns_memory
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shingles with their place: 0 for those that are not frequent, of frequent ones only those in the first places."""
        for batch in batches:
            for rep, n, component, shingles in zip(batch["rep"], batch["n"], batch["component"], batch["shingles"]):
                x = np.asarray(shingles, np.int64)
                k = np.minimum(np.searchsorted(hot_s, x), max(0, len(hot_s) - 1))
                is_hot = hot_s[k] == x if len(hot_s) else np.zeros(len(x), bool)
                cold, k = x[~is_hot], k[is_hot]
                k = k[np.lexsort((hot_s[k], hot_df[k]))][: max(0, n - -(-n * percent // 100) + 1 - len(cold))]
                at = np.concatenate((np.zeros(len(cold), np.int64), len(cold) + 1 + np.arange(len(k))))
                yield pd.DataFrame({"s": np.concatenate((cold, hot_s[k])), "rep": rep, "n": n, "component": component, "at": at})

    spread = scratch.keep(owned.select("rep", "n", "component", "shingles").mapInPandas(placed, "s long, rep long, n long, component long, at long"), "spread")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "s"))
    ranked = spread.where("at = 0").join(stats, "s", "left").withColumn("at", place).unionByName(spread.where("at > 0").join(stats, "s"))
    less, more = F.ceil(F.col("n") * (2 * percent) / (100 + percent)), F.ceil(F.col("n") * percent / 100)
    ranked = ranked.where((F.col("at") <= F.col("n") - more + 1) & (F.col("low") < F.col("high")))
    ranked = ranked.select("s", "rep", "n", "component", "at", (F.col("component") != F.col("major")).alias("minor"), (F.col("at") <= F.col("n") - less + 1).alias("first"))
    prefix = scratch.keep(ranked, "prefix")
    other = prefix.select("s", *(F.col(c).alias(f"{c}_2") for c in ("rep", "n", "component", "at", "first", "minor")))
    smaller = F.struct("n", "rep") < F.struct("n_2", "rep_2")
    enough = F.col("first") & smaller | F.col("first_2") & ~smaller
    left = 1 + F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    able = (F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * percent) & (left * (100 + percent) >= (F.col("n") + F.col("n_2")) * percent)
    once = ~F.col("minor_2") | (F.col("rep") < F.col("rep_2"))
    pairs = prefix.where("minor").join(other, "s").where((F.col("component") != F.col("component_2")) & once & enough & able)
    return pairs.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by alternating large-star and small-star steps.

    Each step is a partial minimum per node and a join back, which a skew join can split; nothing is collected but
    two numbers that tell whether the edges still change.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        near = near.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        joined = near.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
        return out.where("a != b").distinct()

    now, before, step = edges.select("a", "b"), None, 0
    while True:
        now = scratch.keep(star(star(now, True), False), f"{tag}-{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if step:
            scratch.drop(f"{tag}-{step - 1}")
        if tuple(state) == before:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before, step = tuple(state), step + 1


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document of docs (doc_id, text).

    Links documents whose n-word shingle sets have 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    sketched = scratch.keep(docs.mapInPandas(_sketch_rows(n, bands, rows), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"), "sketches")
    real = sketched.where("n_shingles > 0")

    classes = real.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.count("*").alias("size"))
    classes = scratch.keep(classes, "classes")
    places = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowd = places.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    places = scratch.keep(places.join(crowd, "bucket"), "places")

    weight = places.groupBy("rep").agg(F.sum("members").alias("weight"))
    ranked = places.join(weight, "rep")
    lead = ranked.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"), "n")).alias("top"))
    lead = lead.select("bucket", (-F.col("top.minus")).alias("leader"), F.col("top.n").alias("leader_n"))
    placed = scratch.keep(places.join(lead, "bucket"), "placed")
    able = placed.where((F.col("leader") != F.col("rep")) & (F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent))
    pairs = scratch.keep(able.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    first = _verified(pairs, _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), n, scratch, "first"), percent, scratch, "first")
    scratch.drop("sets-first")
    linked = first.where("linked").select("a", "b")
    found = scratch.keep(components(linked, scratch, "cc1"), "found")

    placed = placed.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = F.max(F.when(F.col("rep") == F.col("leader"), F.col("component"))).alias("main")
    parted = placed.groupBy("bucket").agg(main, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    mixed = scratch.keep(placed.join(parted.select("bucket", "main"), "bucket").select("bucket", "rep", "n", "component", "main"), "mixed")
    sets = _sets(docs, mixed.select(F.col("rep").alias("id")), n, scratch, "second")
    apart = mixed.where("component != main")
    inside = mixed.where("component = main").select("rep", "n", "component").distinct()
    outside = apart.drop("bucket").distinct()
    met = apart.groupBy("bucket").agg(F.count("*").alias("met"))
    around = outside.groupBy("main").agg(F.count("*").alias("met"))
    few, many = F.col("met") <= CROWD, F.col("met") > CROWD

    bits = [f"bits{i}" for i in range(SIGNATURE)]
    signed = sets.select(F.col("id").alias("rep"), *(F.col("signature")[i].alias(b) for i, b in enumerate(bits)))
    two = lambda df: df.select(*(F.col(c).alias(c if c == "bucket" else f"{c}_2") for c in df.columns))
    # bits in which two bitmaps differ stand for shingles, one or more each, that only one of the sets has
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_2"))) for x in bits), F.lit(0))
    both_n = F.col("n") + F.col("n_2")
    able = (F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * percent) & ((both_n - differ) * (100 + percent) >= both_n * 2 * percent)
    side = apart.join(met.where(few), "bucket").select("bucket", "rep", "n", "component").join(signed, "rep")
    again = side.join(two(side), "bucket").where((F.col("rep") < F.col("rep_2")) & (F.col("component") != F.col("component_2")) & able).select("rep", "rep_2")
    near = outside.join(around.where(few), "main").select("main", "rep", "n").join(signed, "rep")
    again = again.unionByName(near.join(two(inside.join(signed, "rep")), (F.col("main") == F.col("component_2")) & able).select("rep", "rep_2"))
    again = again.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()

    member = ["rep", "n", "component"]
    crowded = apart.join(met.where(many), "bucket").select(member).unionByName(outside.join(around.where(many), "main").select(member))
    crowded = scratch.keep(crowded.unionByName(inside.join(around.where(many).select(F.col("main").alias("component")), "component").select(member)).distinct(), "crowded")
    if not crowded.isEmpty():
        rare = scratch.keep(rare_shingle_pairs(crowded, sets, percent, scratch), "rare")
        pair = rare.join(signed.withColumnRenamed("rep", "a"), "a").join(two(signed).withColumnRenamed("rep_2", "b"), "b")
        pair = pair.join(crowded.select(F.col("rep").alias("a"), "n"), "a").join(crowded.select(F.col("rep").alias("b"), F.col("n").alias("n_2")), "b")
        again = again.unionByName(pair.where(able).select("a", "b")).distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    again = scratch.keep(again.join(tested, ["a", "b"], "left_anti"), "again")
    second = _verified(again, sets, percent, scratch, "second")
    linked = found.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second.where("linked").select("a", "b"))
    final = scratch.keep(components(linked, scratch, "cc2"), "final")
    for name in ("places", "placed", "pairs", "mixed", "crowded", "crowd", "stats", "spread", "prefix", "rare", "sets-second", "wanted-first", "wanted-second", "again", "verified-first", "verified-second", "found"):
        scratch.drop(name)

    same = ["fp1", "fp2", "n_shingles"]
    group = classes.select(*same, "size", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left").select(*same, "size", F.coalesce("component", "rep").alias("component_id"))
    group = scratch.keep(group, "groups")
    for name in ("classes", "final"):
        scratch.drop(name)
    hot = (group.agg(F.sum("size")).first()[0] or 0) * HOT_SHARE
    every, few = real.select("doc_id", *same), F.broadcast(group.where(F.col("size") > hot).drop("size"))  # fewer than 1 / HOT_SHARE rows
    out = every.join(few, same).unionByName(every.join(few, same, "left_anti").join(group.where(F.col("size") <= hot).drop("size"), same))
    out = out.select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
