import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from civiclink.llm import mixing

from .cases import empty, frame, odd, odd_rows, prose


def test_targets_against_pouring():
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice([0, 5, 100, 1000, 7]) for _ in range(r.randrange(1, 9))]
        weights = [r.choice([1.0, 2.0, 3.0]) for _ in sizes]
        total = 1.5 * sum(sizes)
        got = mixing.targets(sizes, weights, total)
        assert sum(got) == pytest.approx(total) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes))
        level = [g / w for g, w, s in zip(got, weights, sizes) if g < 2 * s - 1e-9]
        assert max(level, default=0) == pytest.approx(min(level, default=0))
        assert all(g / w <= max(level, default=1e18) + 1e-9 for g, w in zip(got, weights))


def test_splitting_tree_keeps_quotas():
    quotas = np.array([100, 7, 0, 1, 35_000])
    for shards in (1, 2, 5, 24):
        split = mixing.split_blocks(quotas, shards, 3)
        assert split.shape == (shards, 5) and (split >= 0).all() and (split.sum(axis=0) == quotas).all()
        assert split.sum(axis=1).max() - split.sum(axis=1).min() <= shards.bit_length() + 1
        assert (split == mixing.split_blocks(quotas, shards, 3)).all()


def test_splits_follow_the_hypergeometric_distribution():
    draws = np.array([mixing.split_blocks(np.array([30, 10]), 4, seed)[0] for seed in range(800)])
    assert abs(draws[:, 0].mean() - 7.5) < 0.15
    assert abs(draws[:, 0].var() - 10 * 0.75 * 0.25 * 30 / 39) < 0.3


def corpus(spark, n=600):
    r = random.Random(3)
    sources = [r.choice(["big"] * 6 + ["b", "c", "d", None]) for _ in range(n)]
    return frame(spark, [prose(i, r.randrange(0, 60)) for i in range(n)], source=sources).repartition(4)


def test_taken_words_come_near_the_targets(spark):
    docs = corpus(spark)
    rows = mixing.mixed(docs, block_words=200, shards=5).collect()
    sizes = {d["doc_id"]: len((d["text"] or "").split()) for d in docs.collect()}
    source = {d["doc_id"]: d["source"] for d in docs.collect()}
    taken, target, size, most = Counter(), {}, Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert len(r["shards"]) == r["copies"] and all(0 <= x < 5 for x in r["shards"])
        taken[s] += r["taken"]
        size[s] += r["size"]
        most[s] = max(most[s], r["size"])
        assert target.setdefault(s, r["target"]) == r["target"]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))
    assert [target[s] for s in names] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in names)
    assert {r["source_size"] for r in rows} == set(size.values())


def test_reruns_and_other_partitions_agree(spark):
    docs = corpus(spark)
    a, b = (sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in mixing.mixed(d, block_words=100).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_mixture_has_each_copy(spark, tmp_path):
    docs = corpus(spark, 200)
    want = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect() if r["copies"]}
    mix = mixing.mixture(docs)
    assert Counter(r["doc_id"] for r in mix.collect()) == want
    assert mix.columns == docs.columns + ["mix_shard", "mix_order"]
    mixing.write_mixture(mix, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == sum(want.values())


def test_blocks_stay_together(spark):
    """All copies of one block of a source are in one shard, and shards get their quota of blocks."""
    docs = frame(spark, [prose(i, 10) for i in range(1000)], source=["s"] * 1000)
    rows = mixing.mixed(docs, share=0.5, block_words=100, shards=4).collect()
    words = defaultdict(int)
    for r in rows:
        for s in r["shards"]:
            words[s] += r["size"]
    assert sum(words.values()) == 5000 and all(abs(w - 1250) <= 150 for w in words.values())


def test_odd_rows(spark):
    docs = odd(spark)
    rows = mixing.mixed(docs).collect()
    assert sorted(r["size"] for r in rows) == sorted(len((r[1] or "").encode().split()) for r in odd_rows())
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns + ["mix_shard", "mix_order"]
    assert mix.count() == sum(r["copies"] for r in rows)


def test_too_many_sources(spark):
    with pytest.raises(ValueError):
        mixing.mixed(frame(spark, ["a", "b", "c"], source=["x", "y", "z"]), max_sources=2)


def test_empty_table(spark):
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixture(empty(spark)).count() == 0
