"""Best-fit packing of tokenised documents into fixed-length sequences, planned over the length histogram.

Every document becomes its token ids plus an end id; one longer than the sequence length is cut into pieces of that
length, the first of which may be shorter. The plan sees only how many pieces have each length (at most `size`
numbers, whatever the corpus): best fit over counts gives runs of equal sequences. A piece then takes a planned slot
by its rank within its length. Ranks need no sort and no group: a task numbers the pieces of each length as it writes
them, and a prefix sum over (length, task) turns that into a rank over all tasks.

Null text counts as empty: the document is its end id alone. Rows with a null doc_id are packed like others.
Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, returns_memory, slices

#: Texts from this length on are encoded without a list of Python numbers.
LONG = 1_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE vocabulary of a tokenizers JSON file as a tiktoken encoding, which gives the same ids, and its added tokens.

    In such a vocabulary a token's id is its merge rank, so the ranks are the vocabulary with its printable stand-ins
    for bytes undone. The split pattern is that of byte-level BPE's pre-tokenizer.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), added


class TokenIds:
    """Token ids of texts."""

    def __init__(self, path: str):
        self.encoding, self.added = encoder(path)
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; an added token's own id where its string stands, as the tokenizer has it."""
        if not any(map(text.__contains__, self.added)):
            return self.plain(text)
        return b"".join(np.array([self.added[x]], "<u4").tobytes() if k % 2 else self.plain(x) for k, x in enumerate(self.apart.split(text)))

    def plain(self, text: str) -> bytes:
        if len(text) < LONG:
            return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()  # the same, without a list


def _pieces(path: str, size: int, end_id: int):
    @returns_memory
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, task, count = TokenIds(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch["text"].where(batch["text"].notna(), "").tolist()
            for a, b in slices(texts):
                rows = []
                for doc, text in zip(batch["doc_id"].iloc[a:b], texts[a:b]):
                    ids = ids_of(text) + tail
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), task, count[end - start]))
                        count[end - start] += 1
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in _PIECES.split(", ")])
                yield out.astype({"doc_id": "Int64"})

    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over a length histogram: runs (length, first rank, last rank + 1, first sequence, offset).

    Lengths go in from long to short. The open sequences are kept by free space as (how many, their contents), and a
    length goes to the fullest that still takes it, as many at once as there are of both. The work depends on the
    distinct lengths, not on the documents.
    """
    free: dict[int, list[list]] = {}
    order: list[int] = []  # free spaces in use, ascending

    def put(space: int, many: int, items: tuple) -> None:
        if space not in free:
            bisect.insort(order, space)
            free[space] = []
        free[space].append([many, items])

    done: list[list] = []
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                fit = size // length
                full, rest = divmod(left, fit)
                for many, items in ((full, fit), (1 if rest else 0, rest)):
                    if many:
                        put(size - items * length, many, (length,) * items)
                left = 0
                continue
            space = order[at]
            many, items = free[space].pop()
            if not free[space]:
                del free[space]
                order.pop(at)
            fit = min(space // length, left)
            take = min(many, left // fit)
            if take < many:
                put(space, many - take, items)
            put(space - fit * length, take, items + (length,) * fit)
            left -= take * fit
    for space in order:
        done += free[space]
    used: dict[int, int] = dict.fromkeys(counts, 0)
    runs, sequence = [], 0
    for many, items in done:
        offset = 0
        for length in items:
            runs.append((length, used[length], used[length] + many, sequence, offset))
            used[length] += many
            offset += length
        sequence += many
    return runs


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.keep(docs.select("doc_id", "text").mapInPandas(_pieces(tokenizer, size, end_id), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = plan(counts, size)
    runs = spark.createDataFrame(runs, "length long, low long, high long, sequence long, offset long")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(runs), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
