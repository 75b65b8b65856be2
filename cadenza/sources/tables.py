"""Intermediate results as tables in the folder that driver and executors share: what several jobs read is computed once,
and a lost executor costs a reread."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else one in the warehouse; a temporary one only where
    the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = f"file://{tempfile.gettempdir()}/cadenza-{os.getpid()}"
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/cadenza-tables").rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone before
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)
