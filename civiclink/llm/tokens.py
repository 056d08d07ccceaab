"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A rollup is a folder. Every batch of changes becomes signed entries, one row per document and
tokenizer version: an insert adds a document and its tokens, a delete takes away what the entries so far say about
the document, a revision takes that away and adds the new count. The totals of the batch, the sums
of its entries by (source, lang, version), are written last; a batch counts once the success mark
of its totals is there. So a batch that was cut off is written anew as a whole, and a batch that
is committed again changes nothing. All totals are sums over committed batches; documents
are never counted again.

The entries of a batch lie in BUCKETS folders by a hash of the document id. A delete or revision reads only
the buckets of its documents, and sums only their entries, however long the history is.

Null text has no tokens. Null source and null language are groups of their own; a null document id can be
deleted and revised like any other. Repeated inserted rows count each; a delete takes all of
them. Deletes and revisions of unknown documents take nothing away. An empty batch commits nothing but its name.
Entries are summed in the map tasks first, so one source with a third of all rows makes no hot task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclink.llm.common import stored

KEYS = ["source", "lang", "version"]
# Fixed value: how the tokenizer cuts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 1 << 20
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
BUCKETS = 256  # fixed for the life of a rollup
ENTRY = "doc_id {kind}, source string, lang string, version string, docs long, tokens long"


@lru_cache(maxsize=4)
def _encoding(name: str, ranks: bytes) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def _slices(text: str) -> Iterator[str]:
    """A long text in slices; the tokenizer always cuts before a blank between two letters or digits."""
    start = 0
    while len(text) - start > SLICE:
        gap = CUT.search(text, start + SLICE)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def count_tokens(
    docs: DataFrame,
    version: str,
    ranks_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, source, lang, version, tokens. `ranks_file` is a vocabulary of base64 tokens and ranks
    on the driver; its bytes go to the executors."""
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(version, shared.value).encode_ordinary
        for batch in batches:
            tokens = [sum(len(encode(part)) for part in _slices(x.as_py() or "")) for x in batch.column("text")]
            names = pa.array([version] * len(tokens), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, pa.array(tokens, pa.int64())], ["doc_id", *KEYS, "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, version string, tokens long")


def count_bytes(docs: DataFrame, version: str = "utf8_bytes", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The same columns for a tokenizer whose tokens are the bytes of the text."""
    return docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        docs[lang_col].cast("string").alias("lang"),
        F.lit(version).alias("version"),
        F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long").alias("tokens"),
    )


class Rollup:
    """Totals of one folder. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.kind, self.entry = id_type, ENTRY.format(kind=id_type)

    def _folder(self, part: str, batch: str) -> str:
        return f"{self.path}/{part}/batch={batch}"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        place, files = self._files(f"{self.path}/totals")
        if not files.exists(place):
            return []
        names = [s.getPath().getName().removeprefix("batch=") for s in files.listStatus(place)]
        return sorted(n for n in names if self._committed(n))

    def _committed(self, batch: str) -> bool:
        place, files = self._files(f"{self._folder('totals', batch)}/_SUCCESS")
        return files.exists(place)

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [self._folder(part, b) for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths).drop("batch")

    def net(self) -> DataFrame:
        """What the committed entries say about each document and version."""
        rows = self._read("entries", self.entry).groupBy("doc_id", *KEYS)
        return rows.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast(self.kind)), F.lit(BUCKETS)).cast("int")

    def _said(self, names: DataFrame) -> DataFrame:
        """What the committed entries say about the documents in `names` (gone_id, of). Only the buckets
        of those documents are read, and only their entries are summed."""
        names = stored(names.distinct().withColumnsRenamed({"doc_id": "gone_id"}))
        buckets = [r[0] for r in names.select(self._bucket("gone_id")).distinct().collect()]  # BUCKETS numbers at most
        rows = self._read("entries", f"{self.entry}, bucket int").where(F.col("bucket").isin(buckets))
        of = F.col("of").isNull() | (F.col("of") == F.col("version"))
        rows = rows.join(names, F.col("doc_id").eqNullSafe(F.col("gone_id")) & of, "left_semi").groupBy("doc_id", *KEYS)
        return rows.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revised: DataFrame | None = None) -> bool:
        """Write one batch; False if it was committed before. inserts and revised have doc_id,
        source, lang, version and tokens, deletes has doc_id. A document is in one of the three only."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch name has letters, digits, dots, dashes and underscores")
        if self._committed(batch):
            return False
        columns = ["doc_id", *KEYS, "docs", "tokens"]
        parts = [self.spark.createDataFrame([], self.entry)]
        added = lambda df: df.select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))
        if inserts is not None:
            parts.append(added(inserts))
        gone = []
        if deletes is not None:
            gone.append(deletes.select("doc_id", F.lit(None).cast("string").alias("of")))
        if revised is not None:
            revised = stored(revised.select("doc_id", *KEYS, "tokens"))  # counted once, used twice
            parts.append(added(revised))
            gone.append(revised.select("doc_id", F.col("version").alias("of")))
        for names in gone:
            old = self._said(names)
            parts.append(old.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        entries = parts[0]
        for part in parts[1:]:
            entries = entries.unionByName(part)
        # A bucket with a document of very many rows is split again by the rebalancing.
        laid = entries.select(*columns, self._bucket("doc_id").alias("bucket")).hint("rebalance", "bucket")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(self._folder("entries", batch))
        entries = self.spark.read.schema(self.entry).parquet(self._folder("entries", batch))
        sums = entries.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(self._folder("totals", batch))
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches."""
        rows = self._read("totals", "source string, lang string, version string, docs long, tokens long")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 OR tokens != 0")
