"""Nested JSON manifests, JSON lines and ZIP bundles as DataFrames, with explicit schemas throughout."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "struct<role:string,label:string,qc:map<string,double>,ranking_score:double>"
MANIFEST = f"schemaVersion int, bundleId string, generatedAt string, candidates array<{CANDIDATE}>"
DECISION = "schemaVersion int, bundleId string, reviewedAt string, finalVerdict string, issueTags array<string>, preferredRole string, confidence double, note string"
_MEMBER = "bundle string, member string, bytes long, content binary"


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of decisions; blank lines are skipped, a malformed one is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", DECISION, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def write_decisions(decisions: DataFrame, path: str) -> None:
    decisions.select(F.to_json(F.struct(*decisions.columns)).alias("value")).write.text(path)


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """A row for each member of the ZIP files under path; one archive is read by one task."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"bundle": [name], "member": [info.filename], "bytes": [info.file_size], "content": [z.read(info)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(members, _MEMBER)


def read_bundles(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Manifests of ZIP bundles, one row for each candidate. One of another schema version, or none at all, ends the job with its bundle's name."""
    texts = unzip(spark, path).where(F.col("member").endswith("manifest.json")).select("bundle", F.col("content").cast("string").alias("text"))
    found = texts.select("bundle", F.from_json("text", MANIFEST).alias("m")).select("bundle", "m.*")
    refused = F.raise_error(F.concat(F.lit("unsupported review bundle schema in "), "bundle")).cast("boolean")
    return _exploded(found.where(F.when(F.col("schemaVersion") == version, True).otherwise(refused)))


def read_manifests(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """manifest.json files anywhere under path, one row for each candidate."""
    files = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path)
    return explode_candidates(files.withColumn("bundle", F.col("_metadata.file_path")), version)


def explode_candidates(manifests: DataFrame, version: int) -> DataFrame:
    return _exploded(manifests.where(F.col("schemaVersion") == version))


def _exploded(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("bundle", "bundleId", F.explode("candidates").alias("c"))
    return rows.select("bundle", "bundleId", "c.*")


def pair_specs(spark: SparkSession, path: str) -> DataFrame:
    """source/result pairs from a JSON list, or from its "pairs" or "selected"; `output` stands in for `result`."""
    one = "array<struct<id:string,source:string,result:string,output:string>>"
    text = spark.read.text(path, wholetext=True)
    bare = F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", one))  # an object would be read as a list of one
    whole = F.coalesce(bare, *(F.from_json(F.get_json_object("value", f"$.{k}"), one) for k in ("pairs", "selected")))
    return text.select(F.explode(whole).alias("p")).select("p.id", "p.source", F.coalesce("p.result", "p.output").alias("result"))


def report(rows: DataFrame, status: str, generated_at: str) -> DataFrame:
    """One JSON document for each partition of rows' `part` column: {generatedAt, status, reports: [...]}."""
    packed = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "part"]))).alias("reports"))
    return packed.select("part", F.to_json(F.struct(F.lit(generated_at).alias("generatedAt"), F.lit(status).alias("status"), "reports")).alias("value"))
