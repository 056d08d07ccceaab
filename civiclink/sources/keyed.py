"""Keyed tables kept as base files and deltas: an upsert writes its own rows, not the whole table.

Layout of a table's folder::

    base/gen=K/_bucket=B/     rows of bucket B as compaction K left them, one per key
    delta/batch=NAME/_bucket=B/   the last row per key of one upsert
    snapshots/00000012.json   what counts: schema, generation of each bucket, deltas in order, batch names

Rows go to buckets by a hash of their keys. A batch counts from the moment its snapshot stands under its final name;
whatever a cut-off run wrote before that is not in any snapshot, and the same batch name writes it anew. A batch
name that a snapshot has is not applied again. A read takes buckets without deltas as they are and merges the others, by
batch and then by the order column. Compaction rewrites the buckets that deltas touch and leaves the rest alone.

One writer at a time; readers are never blocked. Columns that come later are null in earlier rows. Null keys are keys like others.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from civiclink.operators.rows import keep_last

OWN = [StructField("_batch", LongType()), StructField("_bucket", IntegerType())]


class Folder:
    """A folder of any store Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        place = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        place = self._place(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(place)) if self.files.exists(place) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self._place(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write under another name, then rename: a file of the final name is always whole."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.files.create(self._place(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.files.exists(self._place(name)) or not self.files.rename(self._place(draft), self._place(name)):
            raise RuntimeError(f"{name} exists; another writer was faster")

    def drop(self, name: str) -> None:
        self.files.delete(self._place(name), True)


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, seq: str | None = None):
        self.spark, self.keys, self.seq = spark, list(keys), seq
        self.folder, self.path = Folder(spark, path), path.rstrip("/")
        self.first = {"schema": None, "buckets": buckets, "base": {}, "deltas": [], "batches": [], "number": 0}

    # --- snapshots ---------------------------------------------------------------------------

    def snapshot(self) -> dict:
        """The state that counts now."""
        names = [n for n in self.folder.names("snapshots") if re.fullmatch(r"\d{8}\.json", n)]
        return json.loads(self.folder.read(f"snapshots/{names[-1]}")) if names else dict(self.first)

    def batches(self) -> list[str]:
        return self.snapshot()["batches"]

    def _publish(self, state: dict) -> None:
        self.folder.publish(f"snapshots/{state['number']:08d}.json", json.dumps(state))

    # --- reading -----------------------------------------------------------------------------

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(n)).cast("int")

    def _order(self) -> list[str]:
        return ["_batch", *([self.seq] if self.seq else [])]

    def _load(self, state: dict, paths: list[str]) -> DataFrame:
        schema = StructType([*StructType.fromJson(state["schema"]).fields, OWN[0]])
        return self.spark.read.schema(schema).parquet(*paths)

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = range(state["buckets"]) if buckets is None else sorted(set(buckets))
        changed: dict[int, list[str]] = {}
        for d in state["deltas"]:
            for b in d["buckets"]:
                changed.setdefault(b, []).append(f"{self.path}/delta/batch={d['batch']}/_bucket={b}")
        base = {int(b): f"{self.path}/base/gen={g}/_bucket={b}" for b, g in state["base"].items()}
        still = [base[b] for b in wanted if b in base and b not in changed]
        merged = [p for b in wanted if b in changed for p in [*([base[b]] if b in base else []), *changed[b]]]
        parts = []
        if still:
            parts.append(self._load(state, still))
        if merged:
            parts.append(keep_last(self._load(state, merged), self.keys, self._order()))
        if not parts:
            return self.spark.createDataFrame([], StructType([*StructType.fromJson(state["schema"]).fields, OWN[0]]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest row per key; of some buckets only, if given."""
        state = self.snapshot()
        if state["schema"] is None:
            raise ValueError(f"nothing was written to {self.path}")
        return self._rows(state, buckets).drop("_batch")

    def exists(self) -> bool:
        return self.snapshot()["schema"] is not None

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets that hold the keys of some rows: at most as many numbers as the table has buckets."""
        n = self.snapshot()["buckets"]
        return sorted(r[0] for r in rows.select(self._bucket(n).alias("b")).distinct().collect())

    # --- writing -----------------------------------------------------------------------------

    def _merged_schema(self, state: dict, rows: DataFrame) -> StructType:
        known = StructType.fromJson(state["schema"]).fields if state["schema"] else []
        types = {f.name: f.dataType for f in known}
        for f in rows.schema.fields:
            if types.setdefault(f.name, f.dataType) != f.dataType:
                raise ValueError(f"column {f.name} was {types[f.name].simpleString()}, is {f.dataType.simpleString()}")
        return StructType([StructField(n, t, True) for n, t in types.items()])

    def upsert(self, batch: str, rows: DataFrame) -> bool:
        """Apply one batch; False if it was applied before. Of several rows per key the last by the order column counts."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch name has letters, digits, dots, dashes and underscores")
        state = self.snapshot()
        if batch in state["batches"]:
            return False
        number = state["number"] + 1
        last = keep_last(rows.withColumn("_batch", F.lit(number).cast("long")), self.keys, self._order())
        out = last.withColumn("_bucket", self._bucket(state["buckets"])).repartition("_bucket")
        where = f"delta/batch={batch}"
        out.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{where}")
        touched = sorted(int(n.removeprefix("_bucket=")) for n in self.folder.names(where) if n.startswith("_bucket="))
        self._publish(
            state | {
                "schema": self._merged_schema(state, rows).jsonValue(), "number": number, "batches": [*state["batches"], batch],
                "deltas": [*state["deltas"], {"batch": batch, "buckets": touched}],
            }
        )
        return True

    def compact(self) -> list[int]:
        """Merge deltas into the buckets they touch; those buckets."""
        state = self.snapshot()
        touched = sorted({b for d in state["deltas"] for b in d["buckets"]})
        number = state["number"] + 1
        if touched:
            rows = self._rows(state, touched).withColumn("_bucket", self._bucket(state["buckets"])).repartition("_bucket")
            rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/base/gen={number}")
        base = state["base"] | {str(b): number for b in touched}
        self._publish(state | {"number": number, "base": base, "deltas": []})
        return touched

    def tidy(self) -> None:
        """Delete folders that the present snapshot does not name; no reader of an older one may be at work."""
        state = self.snapshot()
        live = {f"gen={g}" for g in state["base"].values()}
        for name in self.folder.names("base"):
            if name not in live:
                self.folder.drop(f"base/{name}")
        live = {f"batch={d['batch']}" for d in state["deltas"]}
        for name in self.folder.names("delta"):
            if name not in live:
                self.folder.drop(f"delta/{name}")
