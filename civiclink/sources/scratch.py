"""Folders every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path under spark.checkpoint.dir. Only a local session without that setting
    falls back to a temporary folder of the machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, keep_shuffles: bool = True) -> DataFrame:
    """Store a frame that several results reuse; a lost executor costs nothing but a re-read. Shuffle files stay on
    disk until the driver collects garbage; without `keep_shuffles` those of this step go as soon as it is stored."""
    spark = df.sparkSession
    path = shared_folder(spark, "stage")
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    try:
        if not keep_shuffles:
            spark.conf.set(_DROP_SHUFFLES, "true")
        df.write.parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.parquet(path)
