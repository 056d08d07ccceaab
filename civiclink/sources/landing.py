"""Guarded landing of raw files: nothing stored is ever overwritten.

A store keeps contents by their checksum, each once, and a table that points from every path to its present version.
Landing a batch of files hashes them, compares them with the pointers, writes the contents the store has not,
then the versions, and switches the pointers last, by one rename (see keyed). A run that is cut off before that changes nothing
that a reader sees; the same batch can simply be landed again. A file that is not in a batch keeps its version:
a landing never deletes.

    contents/batch=NAME/   sha256, size_bytes, content
    versions/batch=NAME/   local_path, version, sha256, size_bytes, batch
    pointers/              keyed table by local_path

Only batches that the pointer table has committed are read. Contents move once, from the scan to their file; comparing and choosing is done on
paths and checksums. Of a path that occurs twice in one batch the last content by checksum counts. A null content is the content
of no file and is left out; an empty one is stored like others. Null paths are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.operators.manifest import changes
from civiclink.sources.keyed import KeyedTable
from civiclink.sources.provenance import checksum
from civiclink.sources.scratch import cut_lineage

CONTENTS = "sha256 string, size_bytes long, content binary"
VERSIONS = "local_path string, version int, sha256 string, size_bytes long, batch string"


class LandingStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointers = KeyedTable(spark, f"{self.path}/pointers", ["local_path"], buckets)

    def _committed(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{part}/batch={b}" for b in self.pointers.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        """local_path, version, sha256, size_bytes, batch of the present version of every path."""
        return self.pointers.read() if self.pointers.exists() else self.spark.createDataFrame([], VERSIONS)

    def versions(self) -> DataFrame:
        """All versions of all paths."""
        return self._committed("versions", VERSIONS)

    def contents(self) -> DataFrame:
        """sha256, size_bytes, content: one row per content."""
        return self._committed("contents", CONTENTS)

    def read(self, version: DataFrame | None = None) -> DataFrame:
        """Present versions, or some rows of versions(), with their content."""
        wanted = self.current() if version is None else version
        return wanted.join(self.contents().select("sha256", "content"), "sha256")

    def land(self, batch: str, files: DataFrame) -> DataFrame:
        """files: local_path, content (binary), as binaryFile reads them or made otherwise. The state of every path: new, changed, unchanged
        or missing, with old and new checksum. A batch that was landed before changes nothing and reports what it finds now."""
        named = files.where("local_path IS NOT NULL AND content IS NOT NULL").select("local_path", F.col("content").cast("binary").alias("content"))
        facts = named.select("local_path", checksum("content").alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))
        facts = cut_lineage(facts.groupBy("local_path").agg(F.max(F.struct("sha256", "size_bytes")).alias("f")).select("local_path", "f.*"))
        before = cut_lineage(self.current())
        state = cut_lineage(changes(before, facts))
        if batch in self.pointers.batches():
            return state
        write = state.where("write_version").select("local_path")
        fresh = facts.join(write, "local_path", "left_semi")
        # One path per content the store has not yet; only these files are read again.
        unknown = fresh.join(self.contents().select("sha256").distinct(), "sha256", "left_anti")
        chosen = unknown.groupBy("sha256").agg(F.min("local_path").alias("local_path"))
        sized = named.withColumn("sha256", checksum("content"))
        kept = sized.join(chosen, ["local_path", "sha256"], "left_semi").dropDuplicates(["sha256"])
        kept = kept.select("sha256", F.octet_length("content").cast("long").alias("size_bytes"), "content")
        kept.write.mode("overwrite").parquet(f"{self.path}/contents/batch={batch}")
        old = before.select(F.col("local_path").alias("_path"), F.col("version").alias("_version"))
        rows = fresh.join(old, F.col("local_path") == F.col("_path"), "left")
        version = (F.coalesce("_version", F.lit(0)) + 1).alias("version")
        rows = rows.select("local_path", version, "sha256", "size_bytes", F.lit(batch).alias("batch"))
        rows.write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch}")
        self._switch(batch)
        return state

    def _switch(self, batch: str) -> None:
        """From here on the batch counts."""
        rows = self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions/batch={batch}")
        self.pointers.upsert(batch, rows)
