"""Keyed provenance tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclink.operators.rows import keep_last
from civiclink.sources.tables import exists


def align_union(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack(*frames: DataFrame, order: str = "source_order") -> DataFrame:
    """Rows of all frames with the position of the frame they came from."""
    return align_union(*[f.withColumn(order, F.lit(i)) for i, f in enumerate(frames)])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Latest row per key. Incoming rows come after existing ones; seq orders rows within each."""
    both = stack(existing, incoming, order="_batch")
    return keep_last(both, keys, ["_batch", seq]).drop("_batch")


def upsert_to(path: str, next_path: str, incoming: DataFrame, keys: list[str], seq: str = "seq") -> str:
    """One batched upsert per run, written to a new path; readers switch to it when it is complete."""
    spark = incoming.sparkSession
    rows = upsert(spark.read.parquet(path), incoming, keys, seq) if exists(spark, path) else keep_last(incoming, keys, seq)
    rows.write.mode("errorifexists").parquet(next_path)
    return next_path


def consolidate(manifests: dict[str, DataFrame]) -> DataFrame:
    """All module manifests as one table with the module they belong to."""
    return align_union(*[m.withColumn("module_name", F.lit(n)) for n, m in manifests.items()])


def outcome_summary(manifest: DataFrame, key: str = "sha256") -> DataFrame:
    """Successes, failures and repeated contents per module."""
    failed = F.col("status") == "failed"
    per_content = manifest.groupBy("module_name", key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad")
    )
    has_content = F.col(key).isNotNull() & (F.col(key) != "")
    return per_content.groupBy("module_name").agg(
        F.sum(F.col("n") - F.col("bad")).alias("successes"),
        F.sum("bad").alias("failures"),
        F.sum(F.when(has_content, F.col("n") - 1).otherwise(0)).alias("duplicates"),
    )


def changes(before: DataFrame, after: DataFrame, key: str = "local_path") -> DataFrame:
    """State of every landed file: new, changed, unchanged or missing. Only a changed checksum
    justifies a new version of a stored file."""
    old = before.select(key, F.col("sha256").alias("old_sha256"))
    new = after.select(key, F.col("sha256").alias("new_sha256"))
    state = (
        F.when(F.col("old_sha256").isNull(), "new")
        .when(F.col("new_sha256").isNull(), "missing")
        .when(F.col("old_sha256") == F.col("new_sha256"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, key, "full").withColumn("state", state).withColumn("write_version", state.isin("new", "changed"))
