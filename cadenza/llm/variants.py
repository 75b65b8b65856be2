"""Spelling variants of words, grouped by rolling-hash deletions.

A word is a maximal run of `[A-Za-z\\u00C0-\\u00FF]`, with A-Z lower-cased; where the crc32 of `<doc_id>:<run>` is
divisible by `slip`, one code point of the run is left out, as a slip of the pen would. Words of at least `least` code
points that occur `times` times are compared: two are near if one inserted, deleted or replaced code point parts them.

1. Tasks count words over whole texts in bounded tables that flow over; counts of all texts are added up by word.
2. With prefix sums P of c[j] * B^j modulo two primes, a word without its code point i hashes to
   P[i] + (P[n] - P[i + 1]) / B: all deletions of a batch of words are a few NumPy operations on integers.
3. Keys are dealt by their leading bits (radix) and sorted. In a run of equal keys, words that lost the same place differ
   by a replacement, and a whole word next to a shortened one by an insertion.
4. Only such rows get their strings, on which they are grouped again, so that equal hashes of different strings change
   nothing. Words that share a string without one place are near each other: a group tells each member how many the
   others are and which is the most frequent, without pairs. At most one word for each letter of the alphabet is in it.

The form of a word is its near word of most occurrences (ties: smallest in code-point order), if that has at least
`ratio` times as many; the root follows forms to the last, by pointer doubling.

Null and empty texts have no words; a null doc_id counts as the empty text in the hash; repeated rows count as often as
they are there. A word of n code points, however long, makes n keys of a few bytes. An empty table gives no rows. Only
doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, broadcast_if_small, returns_memory, slices

_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Two primes under 2**31 and a base for each.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
#: Leading bits of a key that say where it goes.
RADIX_BITS = 12
#: Words, and their code points, that a task counts before it hands them on.
_TABLE_WORDS, _TABLE_CHARS = 200_000, 4_000_000
_LONG_TEXT = 2_000_000


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def words_of(doc_id: str, text: str, slip: int) -> Counter:
    """The words of a text, slips included, with their counts."""
    low = lowered(text)
    runs = Counter(_RUN.findall(low) if len(low) < _LONG_TEXT else (m[0] for m in _RUN.finditer(low)))
    if not slip:
        return runs
    out: Counter = Counter()
    lead = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), lead)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, least: int = 7, times: int = 2, slip: int = 31) -> DataFrame:
    """word, n: words of at least `least` code points with at least `times` occurrences in all texts."""

    @returns_memory
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, int] = {}
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not isinstance(text, str):
                    continue
                for word, n in words_of(doc_id if isinstance(doc_id, str) else "", text, slip).items():
                    if len(word) >= least:
                        if word in table:
                            table[word] += n
                        else:
                            table[word] = n
                            chars += len(word)
                if len(table) > _TABLE_WORDS or chars > _TABLE_CHARS:
                    yield pd.DataFrame({"word": list(table), "n": list(table.values())})
                    table, chars = {}, 0
        yield pd.DataFrame({"word": list(table), "n": list(table.values())}, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    some = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo prime, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * pow(base, len(out), prime) % prime))
    return out[:n]


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, owner, first) of each word whole (place -1) and without each of its code points.

    first: the code point is not equal to the one before it, so that this shortened string is met for the first time.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - begins[owner]
    whole = np.zeros(len(words), np.int64)
    cut = np.zeros(len(code), np.int64)
    for base, prime in zip(BASES, PRIMES):
        term = code * powers(base, prime, int(lengths.max(initial=0)))[place] % prime
        sums = np.concatenate(([0], np.cumsum(term)))  # under 2**63 for 2**32 code points
        total = (sums[ends] - sums[begins]) % prime
        before = sums[:-1] - sums[begins[owner]]
        after = (sums[ends[owner]] - sums[1:]) % prime * pow(base, -1, prime)
        whole = (whole << 31) | total
        cut = (cut << 31) | ((before + after % prime) % prime)
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return (
        np.concatenate((whole, cut)), np.concatenate((np.full(len(words), -1), place)).astype(np.int32),
        np.concatenate((np.arange(len(words)), owner)), np.concatenate((np.ones(len(words), bool), first)),
    )


def meetings(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and place: those that lost the same place as another, and those of a whole word and its
    shortened neighbours."""
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(new_key) - 1
    new_place = new_key | np.concatenate(([True], place[1:] != place[:-1]))
    at = np.cumsum(new_place) - 1
    replaced = (np.bincount(at)[at] > 1) & (place >= 0)
    whole, shortened = place < 0, first & (place >= 0)
    has_whole, has_short = (np.bincount(group, weights=x, minlength=group[-1] + 1)[group] > 0 for x in (whole, shortened))
    return replaced, (whole & has_short) | (shortened & has_whole)


def met(keys: DataFrame) -> DataFrame:
    """id, place, kind (replaced or inserted) of the rows whose key meets another's."""

    @returns_memory
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(rows):
                kinds = meetings(rows["key"].to_numpy(), rows["place"].to_numpy(), rows["first"].to_numpy(bool))
                for kind, hit in zip(("replaced", "inserted"), kinds):
                    if hit.any():
                        yield rows.loc[hit, ["id", "place"]].assign(kind=kind)

        rest: list[pd.DataFrame] = []  # rows of the last key, which may go on
        for batch in batches:
            if not len(batch):
                continue
            key = batch["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (rest and rest[0]["key"].iloc[0] != key[-1]):
                yield from found(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True))
                rest = []
            rest.append(batch.iloc[cut:])
        if rest:
            yield from found(pd.concat(rest, ignore_index=True))

    radix = F.shiftrightunsigned("key", 62 - RADIX_BITS)
    return keys.repartition(radix).sortWithinPartitions("key", "place").mapInPandas(run, "id long, place int, kind string")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near, best struct<lost, word> (lost: minus its count) of words (id, word, n) that have near words."""

    @returns_memory
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, ids = batch["word"].tolist(), batch["id"].to_numpy()
            for a, b in slices(some):
                key, place, owner, first = deletion_keys(some[a:b])
                yield pd.DataFrame({"key": key, "place": place, "id": ids[a:b][owner], "first": first})

    keys = words.select("id", "word").mapInPandas(keyed, "key long, place int, id long, first boolean")
    rows = met(keys).join(words, "id")
    short = F.concat(F.left("word", F.col("place")), F.substr("word", F.col("place") + 2))
    rows = scratch.keep(rows.select("kind", "place", "word", F.struct((-F.col("n")).alias("lost"), "word").alias("self"), F.when(F.col("place") < 0, F.col("word")).otherwise(short).alias("rest")), "met")

    groups = rows.where("kind = 'replaced'").groupBy("rest", "place").agg(F.sort_array(F.collect_list("self")).alias("all"))  # one for each letter at most
    replaced = groups.where(F.size("all") > 1).select("all", F.explode("all").alias("self"))
    others = F.when(F.col("self") == F.col("all")[0], F.col("all")[1]).otherwise(F.col("all")[0])
    replaced = replaced.select(F.col("self.word").alias("word"), (F.size("all") - 1).cast("long").alias("near"), others.alias("best"))
    whole = rows.where("kind = 'inserted' and place < 0").select("rest", F.col("self").alias("long"))
    both = rows.where("kind = 'inserted' and place >= 0").select("rest", F.col("self").alias("short")).join(whole, "rest")
    inserted = [both.select(F.col(f"{a}.word").alias("word"), F.lit(1).cast("long").alias("near"), F.col(b).alias("best")) for a, b in (("short", "long"), ("long", "short"))]
    every = replaced.unionByName(inserted[0]).unionByName(inserted[1])
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: the end of each chain of forms (word, form), by pointer doubling; counts grow along a chain, so that it
    is short and has no circle."""
    roots, k = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = broadcast_if_small(roots.select(F.col("word").alias("root"), F.col("root").alias("next")))
        k += 1
        moved = roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = scratch.keep(moved, f"roots-{k}")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        scratch.drop(f"roots-{k - 1}")
        roots = moved.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, slip: int = 31, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row for each word."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.keep(word_counts(docs, least, times, slip).withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words, scratch)
    joined = words.select("word", "n").join(near, "word", "left")
    fits = -F.col("best.lost") >= F.col("n") * ratio
    judged = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.lost")).alias("form_n"))
    judged = scratch.keep(judged, "judged")
    roots = last_forms(judged.where("form is not null"), scratch)
    return judged.join(broadcast_if_small(roots), "word", "left").withColumn("root", F.coalesce("root", "word"))
