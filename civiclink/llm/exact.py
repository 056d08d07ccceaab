"""Exact duplicates by a two-pass Bloom filter.

The first pass counts, in a counting Bloom filter that stops at two, the 64-bit hash of every
normalised text. The second pass asks the filter: a row with a slot that was hit once has no copy
and passes straight through; only rows whose slots were all hit twice or more are shuffled by the
SHA-256 of their text and grouped. The filter has no false negatives, and a false positive is a
group of one, so the result is exact at any fill.

Hashes are spread over generations of about `generation_rows` rows, each with a filter of its
own of `slots_per_row` slots per row: that bounds the broadcast filter (128 MB at the default) for
any number of rows. Within a filter the slots of a row lie in one block, so tasks build and merge
filters block by block; a task that has few hashes of a block ships the hashes instead of its bits.

With more than one generation the hashes, not the texts, are written into one folder per
generation, without a shuffle, by as many tasks as there are generations. All filters are then built in one pass, and
each generation asks its own filter over its own folder; its broadcast is released before the next.
So every hash is read three times, whatever the number of generations.

Null text counts as empty. Of equal texts the smallest id stays, a null id only if there is no
other; of repeated rows with that id one stays. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import BLANKS, packed, stored, text_or_empty, unpacked
from civiclink.sources.scratch import shared_folder

PROBES = 4
BLOCK_SLOTS = 1 << 16
GENERATION_ROWS = 1 << 26
SLOTS_PER_ROW = 16


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, sha (hex), h (64-bit hash of sha): one row per row of `docs`."""
    text = F.regexp_replace(text_or_empty(text_col), BLANKS, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sha", F.xxhash64("sha").alias("h"))


def _slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and PROBES slots inside it of each hash."""
    bits = h.view(np.uint64)
    block = (bits % np.uint64(blocks)).astype(np.int64)
    mixed = (bits ^ (bits >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return block, np.stack([(mixed >> np.uint64(16 * i)) & np.uint64(BLOCK_SLOTS - 1) for i in range(PROBES)], axis=1)


PARTIAL = "gen long, block long, few binary, once binary, twice binary"


def _bits(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter bits of a block: slots hit once or more, slots hit twice or more."""
    times = np.bincount(slots.astype(np.int64).ravel(), minlength=BLOCK_SLOTS)
    return np.packbits(times >= 1), np.packbits(times >= 2)


def _counted(blocks: int):
    """Rows (gen, h) -> partial filters, one row per block of a generation that a task touched:
    its few hashes (one that is there again twice), or its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("gen").to_numpy(), b.column("h").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        gens, hashes = (np.concatenate(x) for x in zip(*parts))
        for gen in np.unique(gens):
            h, times = np.unique(hashes[gens == gen], return_counts=True)
            h = np.concatenate([h, h[times > 1]])
            block = _slots(h, blocks)[0]
            order = np.argsort(block, kind="stable")
            h, block = h[order], block[order]
            names, starts = np.unique(block, return_index=True)
            for name, a, b in zip(names, starts, [*starts[1:], len(block)]):
                mine = h[a:b]
                sparse = mine.nbytes < BLOCK_SLOTS // 4
                held = [mine.tobytes(), None, None] if sparse else [None, *(x.tobytes() for x in _bits(_slots(mine, blocks)[1]))]
                columns = [pa.array([gen], pa.int64()), pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in held)]
                yield pa.RecordBatch.from_arrays(columns, ["gen", "block", "few", "once", "twice"])

    return run


def _merged(blocks: int):
    """Partial filters sorted by generation and block -> one row (gen, block, twice) per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([twice.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["gen", "block", "twice"])

        for batch in batches:
            for gen, block, few, o, t in zip(*(batch.column(i) for i in range(5))):
                if few.is_valid:
                    o, t = _bits(_slots(np.frombuffer(few.as_py(), np.int64), blocks)[1])
                else:
                    o, t = np.frombuffer(o.as_py(), np.uint8), np.frombuffer(t.as_py(), np.uint8)
                if (gen.as_py(), block.as_py()) == name:
                    once, twice = once | o, twice | t | (once & o)
                else:
                    if name is not None:
                        yield out()
                    name, once, twice = (gen.as_py(), block.as_py()), o, t
        if name is not None:
            yield out()

    return run


def _suspected(blocks: int, shared):
    """Adds `again`: whether a hash was possibly seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            block, slots = _slots(batch.column("h").to_numpy(), blocks)
            at = block[:, None] * BLOCK_SLOTS + slots.astype(np.int64)
            hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield batch.append_column("again", pa.array(hit))

    return run


def _filters(rows: DataFrame, blocks: int) -> DataFrame:
    """gen, block, twice: the filters of all generations of `rows` (gen, h), in one pass over them."""
    partial = rows.select("gen", "h").mapInArrow(_counted(blocks), PARTIAL)
    dealt = partial.repartition("gen", "block").sortWithinPartitions("gen", "block")
    return dealt.mapInArrow(_merged(blocks), "gen long, block long, twice binary")


def _asked(rows: DataFrame, filters: DataFrame, blocks: int, path: str) -> None:
    """Write the rows of one generation to `path` with `again`. The filter of that generation comes
    to the driver and goes out again, and is released behind the write."""
    size = BLOCK_SLOTS // 8
    bits = bytearray(blocks * size)
    for block, twice in filters.select("block", "twice").toLocalIterator():
        bits[block * size : (block + 1) * size] = twice
    shared = rows.sparkSession.sparkContext.broadcast(bytes(bits))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows.mapInArrow(_suspected(blocks, shared), f"{kinds}, again boolean").write.parquet(path)
    shared.destroy()


def possibly_repeated(rows: DataFrame, generation_rows: int = GENERATION_ROWS, slots_per_row: int = SLOTS_PER_ROW) -> DataFrame:
    """`rows` (a stored frame with a column h) with `again`, stored; false only for hashes that occur once."""
    spark, count, columns = rows.sparkSession, rows.count(), rows.columns
    generations = max(1, -(-count // generation_rows))
    blocks = max(1, -(-(-(-count // generations) * slots_per_row) // BLOCK_SLOTS))
    asked = shared_folder(spark, "asked")
    if generations == 1:
        _asked(rows, stored(_filters(rows.withColumn("gen", F.lit(0).cast("long")), blocks)), blocks, asked)
        return spark.read.parquet(asked)
    laid, built = shared_folder(spark, "generations"), shared_folder(spark, "filters")
    gen = F.pmod(F.shiftrightunsigned("h", 40), F.lit(generations)).alias("gen")
    rows.select(*columns, gen).coalesce(generations).write.partitionBy("gen").parquet(laid)
    layout = spark.read.schema(f"{rows.schema.toDDL()}, gen long").parquet(laid)
    _filters(layout, blocks).write.partitionBy("gen").parquet(built)
    # One small number per generation is on the driver.
    for (one,) in spark.read.parquet(built).select(F.col("gen").cast("long")).distinct().collect():
        part = spark.read.schema(rows.schema).parquet(f"{laid}/gen={one}")
        _asked(part, spark.read.parquet(f"{built}/gen={one}"), blocks, f"{asked}/gen={one}")
    return spark.read.parquet(asked).select(*columns, "again")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generation_rows: int = GENERATION_ROWS,
    slots_per_row: int = SLOTS_PER_ROW,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = possibly_repeated(stored(hashed(docs, id_col, text_col)), generation_rows, slots_per_row)
    alone = rows.where(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    suspects = rows.where("again")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    # One row per suspected text, stored: the join then deals out both sides itself and can split a hot text.
    groups = stored(suspects.groupBy("sha").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size")))
    again = suspects.join(groups, "sha").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(again)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Rows of `docs`, all columns, one per distinct normalised text."""
    found = exact_duplicates(docs, id_col, text_col, **how)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), (F.col("group_size") > 1).alias("_many"))
    rows = packed(docs)
    text = F.regexp_replace(F.coalesce(F.col("_row").getField(text_col).cast("string"), F.lit("")), BLANKS, " ")
    rows = rows.withColumn("_s", F.sha2(text.cast("binary"), 256))
    rows = rows.join(stored(kept), F.col("_row").getField(id_col).eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha")))
    single = rows.where(~F.col("_many")).select("_row")
    again = rows.where("_many").groupBy("_s").agg(F.first("_row").alias("_row")).select("_row")
    return unpacked(single.unionByName(again), docs.columns)
