import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from civiclink.llm import sharding

from .cases import empty, odd, odd_rows


def test_table_of_odd_rows(spark):
    got = sharding.shard_table(odd(spark), 4).collect()
    data = lambda t: (t or "").encode()
    key = lambda i: (i is None, i or 0)
    want = sorted((key(r[0]), len(data(r[1])) + 8, zlib.crc32(data(r[1]))) for r in odd_rows())
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, shards = defaultdict(list), {}
    for r in got:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 4) and 0 <= r["shard"] < 4
        assert shards.setdefault(r["doc_id"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    weights = [1.0, 2.0, 0.0, 5.0]
    rows = sharding.with_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), weights, grown=[*weights, 2.0]).collect()
    n = Counter(r["shard"] for r in rows)
    assert n[2] == 0
    for i, w in enumerate(weights):
        assert abs(n[i] - 20_000 * w / 8) < 300
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 4 for r in moved) and abs(len(moved) - 4000) < 300


def test_equal_weights_agree_with_weighted_scores(spark):
    rows = spark.range(500).select(
        sharding.shard_of(F.col("id"), [1.0] * 7).alias("a"), sharding.shard_of(F.col("id"), [2.0] * 6 + [2.0 + 1e-12]).alias("b")
    )
    assert rows.where("a != b").count() == 0


def test_slots_over_buckets(spark, tmp_path):
    rows = sharding.with_shards(spark.range(5000).withColumnRenamed("id", "doc_id"), [1.0, 3.0])
    rows.write.parquet(str(tmp_path / "rows"))
    got = sharding.with_slots(spark.read.parquet(str(tmp_path / "rows")), ["doc_id"], bucket_rows=100).collect()
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_columns_of_all_rows_survive(spark, tmp_path):
    out = sharding.sharded(odd(spark), [1.0, 1.0], order=["doc_id", "text"])
    assert sorted(out.columns) == sorted(odd(spark).columns)
    assert out.count() == len(odd_rows())
    sharding.write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(odd_rows())


def test_bad_weights(spark):
    for weights in ([], [0.0], [-1.0, 1.0]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit(1), weights)


def test_empty_table(spark):
    assert sharding.shard_table(empty(spark), 3).count() == 0
