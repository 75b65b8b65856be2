"""A training-data pipeline of five corpus operators over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, lines, minhash, packing, quality
from cadenza.llm.queries import table, tokenizer_path
from cadenza.llm.shared import Scratch, broadcast_if_small

#: The stages learn from and compare whole texts in ways that SQL does not express. Tests hold each operator against brute
#: force or held-out labels, each stage on awkward rows, and the whole against planted documents.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go.

    Null and empty texts are judged as empty texts; repeated rows stay or go together; a score equal to the threshold
    stays. An empty table stays empty; without labels of both classes all documents stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; the documents stay, with their new length.

    A null text stays null, with a null length; a null source counts as the empty one; repeated rows are pages of their
    own; a line at exactly the ratio stays; an empty table stays empty.
    """
    cut = lines.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows with a null doc_id stay, and null or empty texts, which are linked with nothing. Repeated rows of the smallest
    doc_id stay as often as they are there. An empty table stays empty.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    gone = Scratch(spark, "gone").keep(gone, "ids")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    It works on texts, so ids may be null or repeated; null and empty texts stay; an empty benchmark or table changes
    nothing. Input columns of any name pass.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the remaining documents in sequences of 1024 tokens.

    A null or empty text is its end id alone; repeated rows and rows with a null doc_id are packed once each; an empty
    table gives no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_site_lines),
    ("near_dedup", keep_one_of_near),
    ("decontaminate", drop_benchmark),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
