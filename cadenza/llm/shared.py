"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handled in slices of about this many characters, so a task's memory does not follow the batch size.
SLICE_CHARS = 400_000


#: A side estimated to hold no more than this may be broadcast.
BROADCAST_BYTES = 16_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder, else one in
    the warehouse; a temporary one only where the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = f"file://{tempfile.gettempdir()}/cadenza-{os.getpid()}"
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/cadenza-scratch").rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a reread, not the work before it.

    What a result still reads stays until the driver ends; then all goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001  the JVM may be gone before
            pass

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """Append df to a table."""
        path = f"{self.root}/{name}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes_of(field: T.StructField) -> Column:
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        of = 64 if isinstance(kind.elementType, T.StructType) else 32 if isinstance(kind.elementType, T.StringType) else 8
        return F.coalesce(F.array_size(c), F.lit(0)) * of + 24
    return F.lit(8)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df's rows are estimated to hold no more than so many bytes, by the lengths of its texts and arrays."""
    row = sum(map(_bytes_of, df.schema.fields), F.lit(16))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured to be small enough, else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, most) else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with signs added until none is among the columns (whatever case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def returns_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches after which its Python worker, which later tasks use again, gives free memory back."""

    @wraps(run)
    def mapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return mapped


def slices(texts: list[str], chars: int = SLICE_CHARS):
    """(from, to) ranges of the list with about so many characters each; a longer text stands alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def span_texts(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(found: DataFrame, base: list[str]) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans as text, of spans array<struct<kind, start, end>> in order."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(span_texts(of_base), 256).alias("base_sha256"), span_texts(F.col("spans")).alias("spans"))


class Taken:
    """Disjoint stretches of a text, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def covers(self, place: int) -> bool:
        at = bisect_right(self.starts, place)
        return bool(at) and self.ends[at - 1] > place

    def add(self, s: int, e: int) -> bool:
        """Take a stretch if all of it is free."""
        at = bisect_left(self.starts, e)  # the stretches before it start before e
        if at and self.ends[at - 1] > s:
            return False
        self.starts.insert(at, s), self.ends.insert(at, e)
        return True
