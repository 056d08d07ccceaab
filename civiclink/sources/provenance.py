"""Checksums and sizes of landed files, as manifest rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.functions.text import col

LARGEST = 1 << 30
BLOCK = 8 << 20
# Tasks that files above LARGEST are dealt out to.
TASKS = 200


def checksum(content: Column | str) -> Column:
    return F.sha2(col(content), 256)


def _stream(path: str):
    """A file of Spark's file listing, opened for reading from its start."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        store, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(rest, safe='/:@')}")
    return store.open_input_stream(name, compression=None)


def _block_hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for path in batch.column("local_path").to_pylist():
            digest = hashlib.sha256()
            with _stream(path) as data:
                while block := data.read(BLOCK):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["local_path", "size_bytes", "sha256"])


def file_facts(spark: SparkSession, pattern: str, largest: int | None = None) -> DataFrame:
    """local_path, sha256 and size of every file; each file is read by one task, none by the driver.

    A cell holds at most 2 GB, so a file above LARGEST bytes is read by its path, in blocks, within a task. A
    caller that gives `largest` asks for files above that size to be left unread, with a null checksum."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    limit = LARGEST if largest is None else largest
    facts = [F.col("path").alias("local_path"), F.col("length").alias("size_bytes")]
    small = files.where(F.col("length") <= limit).select(*facts, checksum("content").alias("sha256"))
    large = files.where(F.col("length") > limit).select(*facts)
    if largest is None:
        large = large.repartition(TASKS, "local_path").mapInArrow(_block_hasher, "local_path string, size_bytes long, sha256 string")
    else:
        large = large.withColumn("sha256", F.lit(None).cast("string"))
    return small.unionByName(large).select("local_path", "sha256", "size_bytes")


def manifest_rows(wanted: DataFrame, facts: DataFrame, created_at_utc: str) -> DataFrame:
    """Manifest rows for (item_type, source_url, local_path, status, notes); a file that does not
    exist gets an empty checksum and size 0; one that was left unread keeps its null checksum."""
    return wanted.join(facts, "local_path", "left").select(
        "item_type",
        "source_url",
        "local_path",
        F.when(F.col("size_bytes").isNull(), F.lit("")).otherwise(F.col("sha256")).alias("sha256"),
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.lit(created_at_utc).alias("created_at_utc"),
        "status",
        "notes",
    )
