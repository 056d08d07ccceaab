"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of a mix are `share` times the words of all documents. Sources divide them by weight; a
source gives at most `limit` times its own words, and what it cannot give is divided among the
others by weight until none is above its limit.

A source's documents stand in an order given by a hash of id and text. Its stretch of the mix
is that order, repeated if the target is larger than the source, up to the target; a document belongs to the
stretch as often as its middle word lies in it. So a source misses its target by half a document
at most. The stretch is cut into an exact number of blocks of about `block_words` words.

The block quotas of all sources are divided among the output shards by a binary tree: at each node
the left half of the shards gets a multivariate-hypergeometric draw of the node's blocks, the right half
the rest. Each shard then draws its blocks from a permutation of the source's blocks, disjoint from those of
all other shards, and orders what it got by another hash. Only one row per source and
shard is handled on the driver; positions come from word counts per (source, hash bucket), so a
source with a third of all rows is spread over as many buckets as its rows need.

Null text has no words. The null source is a source and comes last. Documents without words belong to the
stretch like others and add nothing; a source without words gives nothing. Of repeated rows each
has its own place; which of them is taken does not show. An empty table gives an empty result.
Columns of the same name as added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from civiclink.llm.common import packed, stored, unpacked

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
BLOCK_WORDS = 1 << 16
BUCKET_ROWS = 8192
MAX_SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float = LIMIT) -> list[float]:
    """Words of each source: `total` divided by weight, none above `limit` times its size."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0], total
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight >= limit * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_blocks(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """Blocks of each source (column) in each shard (row)."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def divide(low: int, high: int, mine: np.ndarray) -> None:
        if high - low == 1:
            out[low] = mine
            return
        middle = (low + high) // 2
        draw = int(mine.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(mine, draw, method="marginals")
        divide(low, middle, left)
        divide(middle, high, mine - left)

    if len(quotas) and shards:
        divide(0, shards, np.asarray(quotas, np.int64))
    return out


def _step(blocks: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, b): block -> (a * block + b) mod blocks is a permutation."""
    if blocks < 2:
        return 1, 0
    while True:
        a = int(rng.integers(1, blocks))
        if gcd(a, blocks) == 1:
            return a, int(rng.integers(0, blocks))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = docs[text_col].cast("string")
    return stored(
        docs.select(
            docs[id_col].alias("doc_id"),
            docs[source_col].cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), docs[id_col], text).alias("h"),
            F.xxhash64(text).alias("k"),
        )
    )


def _placed(rows: DataFrame) -> DataFrame:
    """`rows` with `at`: words before each document in the order of its source. `bits` of the hash are
    the bucket, so a source has as many buckets as its own rows need."""
    bucket = F.expr("CASE WHEN bits > 0 THEN shiftrightunsigned(h, 64 - bits) ELSE 0L END")
    # Dealt out by both columns, so that no earlier partitioning by source alone is kept for the window.
    rows = rows.withColumn("bucket", bucket).repartition("source", "bucket")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.expr("sum(words) OVER (PARTITION BY source ORDER BY bucket) - words")
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("start"))
    inside = F.expr("sum(size) OVER (PARTITION BY source, bucket ORDER BY h, k, doc_id ROWS UNBOUNDED PRECEDING) - size")
    rows = rows.withColumn("inside", inside).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.withColumn("at", F.col("start") + F.col("inside")).drop("s", "b", "start", "inside", "bucket")


def _plan(found: list[Row], weights: Sequence[float], share: float, limit: float, shards: int, block_words: int, seed: int) -> list[tuple]:
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in found]
    weight = [float(weights[i % len(weights)]) for i in range(len(found))]
    wanted = targets(sizes, weight, share * sum(sizes), limit)
    quotas = np.array([max(1, round(t / block_words)) if t else 0 for t in wanted], np.int64)
    split = split_blocks(quotas, shards, seed)
    starts = np.concatenate([np.zeros((1, len(found)), np.int64), np.cumsum(split, axis=0)])
    out = []
    for i, r in enumerate(found):
        a, b = _step(int(quotas[i]), np.random.default_rng([seed, 7, i]))
        bits = max(0, -(-int(r["n"]) // BUCKET_ROWS) - 1).bit_length()
        out.append((r["source"], sizes[i], wanted[i], int(quotas[i]), a, b, bits, starts[:, i].tolist()))
    return out


PLAN = pa.schema(
    {
        "plan_source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "quota": pa.int64(),
        "a": pa.int64(), "b": pa.int64(), "bits": pa.int32(), "starts": pa.list_(pa.int64()),
    }
)


def _shard(copy: Column) -> Column:
    """Output shard of one copy of a placed document."""
    middle = F.col("at") + F.col("size") / 2 + copy * F.col("source_size")
    block = F.least(F.floor(middle * F.col("quota") / F.col("target")), F.col("quota") - 1)
    position = F.pmod(F.col("a") * block + F.col("b"), F.col("quota"))
    # Shard s owns the permuted positions from starts[s] up to starts[s + 1].
    return (F.size(F.filter("starts", lambda s: s <= position)) - 1).cast("int")


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    shards: int = 24,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, copies, shards (one per
    copy), and h and k, which name the row."""
    rows = _rows(docs, id_col, text_col, source_col, seed)
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; group them before mixing")
    # An Arrow table becomes a relation of known size, so a small plan is broadcast and rows stay where they are.
    columns = zip(*_plan(found, weights, share, limit, shards, block_words, seed)) if found else [()] * len(PLAN)
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, PLAN.types)], schema=PLAN)
    plan = rows.sparkSession.createDataFrame(table)
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    placed = _placed(rows.join(plan.select("plan_source", "bits"), same).drop("plan_source")).drop("bits")
    placed = placed.join(plan.drop("bits"), same)
    times = F.ceil((F.col("target") - F.col("at") - F.col("size") / 2) / F.col("source_size"))
    copies = F.when(F.col("source_size") > 0, F.greatest(times, F.lit(0))).otherwise(0).cast("int")
    placed = placed.withColumn("copies", copies)
    many = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return placed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.transform(many, _shard).alias("shards"), "h", "k"
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all columns, mix_shard and
    mix_order (the order inside the shard)."""
    found = mixed(docs, id_col, text_col, seed=seed, **how).where(F.col("copies") > 0)
    # Repeated rows share a name: their copies are added up and one of them is taken that often.
    found = stored(found.groupBy(F.col("h").alias("_h"), F.col("k").alias("_k")).agg(F.flatten(F.collect_list("shards")).alias("_shards"), (F.count(F.lit(1)) > 1).alias("_many")))
    row = lambda c: F.col("_row").getField(c)
    rows = packed(docs)
    h = F.xxhash64(F.lit(seed), row(id_col), row(text_col).cast("string"))
    rows = rows.join(found, (h == F.col("_h")) & (F.xxhash64(row(text_col).cast("string")) == F.col("_k")))
    names = ["_row", "_shards", "_h"]
    again = rows.where("_many").groupBy("_h", "_k").agg(F.first("_row").alias("_row"), F.first("_shards").alias("_shards")).select(*names)
    rows = rows.where(~F.col("_many")).select(*names).unionByName(again)
    rows = rows.select("_row", "_h", F.posexplode("_shards").alias("_copy", "_shard"))
    keep = [c for c in docs.columns if c.lower() not in ("mix_shard", "mix_order")]
    order = F.xxhash64(F.lit(seed), "_shard", "_h", "_copy")
    return rows.select(*[row(c).alias(c) for c in keep], F.col("_shard").alias("mix_shard"), order.alias("mix_order"))


def write_mixture(mix: DataFrame, path: str) -> None:
    """One folder per shard, each file in the shard's shuffled order."""
    mix.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
