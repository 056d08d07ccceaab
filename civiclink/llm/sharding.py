"""Records over weighted shards by rendezvous hashing.

Each (record key, shard number) pair has a number u in (0, 1) from the first 52 bits of the MD5 of
"key:shard"; the shard with the largest weight / -ln(u) gets the record. With a further shard a
record either stays or moves into the new one, and a shard gets records in proportion to its weight.
Equal weights need no logarithm: the largest u wins. Nothing but the key and the weights decides, so
the assignment needs no shuffle.

A null key is the key "null". Repeated rows share a shard. Equal numbers go to the lower
shard. Added columns replace input columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclink.llm.common import packed, stored

HEX_DIGITS = 13
BUCKET_ROWS = 8192


def _score(key: Column, shard: int, weight: float, plain: bool) -> Column:
    digest = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, HEX_DIGITS)
    if plain:
        return digest  # of equal length, so the order of the texts is the order of the numbers
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
    return F.lit(float(weight)) / -F.ln(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number 0 .. len(weights) - 1 of a record key; a weight of zero takes nothing."""
    if not weights or min(weights) < 0 or not max(weights):
        raise ValueError("weights must be positive numbers or zero, one of them positive")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    live = [(i, w) for i, w in enumerate(weights) if w]
    plain = len({w for _, w in live}) == 1
    best = [F.struct(_score(key, i, w, plain).alias("score"), F.lit(-i).alias("shard")) for i, w in live]
    return -(F.greatest(*best) if len(best) > 1 else best[0]).getField("shard")


def with_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", grown: Sequence[float] | None = None) -> DataFrame:
    """All columns, `shard`, and `grown_shard` under the weights `grown`, if given."""
    out = docs.withColumn("shard", shard_of(docs[id_col], weights))
    return out if grown is None else out.withColumn("grown_shard", shard_of(docs[id_col], grown))


def with_slots(rows: DataFrame, order: Sequence[str], shard_col: str = "shard", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns and `slot`: 0, 1, 2 .. in each shard. `rows` is read twice, so it should be a table or a
    few expressions over one; whole rows move once, to their bucket.

    A shard is cut into buckets by a hash of the `order` columns; buckets are numbered one by one and
    start where the counts of the earlier ones end. No task sees more than a bucket, but
    for rows that agree in all `order` columns."""
    row = lambda c: F.col("_row").getField(c)
    n = max(1, rows.count() // bucket_rows)
    parts = packed(rows).withColumn("_shard", F.coalesce(row(shard_col), F.lit(-1))).withColumn("_bucket", F.pmod(F.xxhash64(*[row(c) for c in order]), F.lit(n)))
    counts = parts.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.expr("sum(_n) OVER (PARTITION BY _shard ORDER BY _bucket) - _n")
    starts = counts.select(F.col("_shard").alias("_s"), F.col("_bucket").alias("_b"), before.alias("_start"))
    ranked = parts.withColumn("_sort", F.struct(*[row(c) for c in order])).withColumn("_rank", F.expr("row_number() OVER (PARTITION BY _shard, _bucket ORDER BY _sort)"))
    # The keys are those of the window, so whole rows are not dealt out again for the join.
    out = ranked.join(starts, (F.col("_shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    slot = (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot")
    return out.select(*[row(c).alias(c) for c in rows.columns if c.lower() != "slot"], slot)


def sharded(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", order: Sequence[str] | None = None, **how) -> DataFrame:
    """All columns with `shard` and `slot`, ready to be written with partitionBy("shard"). `docs` should be
    a table: its shards are worked out twice, which is cheaper than a copy of all texts."""
    return with_slots(with_shards(docs, weights, id_col), list(order or [id_col]), **how)


def shard_table(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of text and 8), text_crc32, law, shard, slot, grown_shard (one more shard)."""
    data = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = stored(with_shards(rows, [1.0] * shards, "doc_id", [1.0] * (shards + 1)))
    return with_slots(rows, ["doc_id", "size", "text_crc32"])


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard; a shard of many rows is written by many tasks."""
    rows.write.partitionBy("shard").mode("errorifexists").parquet(path)
