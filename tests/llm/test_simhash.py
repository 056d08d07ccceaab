import random
import re

import numpy as np
import pytest
import xxhash

from civiclink.llm import simhash

from .cases import empty, frame, odd, odd_rows, prose


def plain_fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    """Smallest index reachable, for a list of fingerprints."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def joined(edges):
    """Smallest value reachable from each value of some edges."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_of_long_and_short_texts():
    for text in [None, "", " \n", "A", "a B", "A b C", prose(1, 400), prose(2, 300_000)[:1_500_000]]:
        data = None if text is None else text.encode()
        assert simhash.fingerprint(data, 3) == signed(plain_fingerprint(text))


@pytest.mark.parametrize("crowd", [4096, 2])
def test_links_and_components_against_all_pairs(spark, crowd):
    r = random.Random(5)
    values = [0]
    for _ in range(40):
        center = r.getrandbits(64)
        values.append(center)
        for _ in range(r.randrange(30)):
            near = center
            for b in r.sample(range(64), r.randrange(5)):
                near ^= 1 << b
            values.append(near)
            if r.random() < 0.4:
                center = near
    values = sorted(set(values), key=signed)
    want = plain_components(values, 3)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    edges = simhash.links(prints, 3, 2, crowd).cache()
    got = joined([tuple(r) for r in edges.collect()])
    if crowd == 2:
        stars = {u: v for u, v in simhash.components(edges).collect()}
        assert stars == {u: v for u, v in got.items() if u != v}
    for i, v in enumerate(values):
        assert got.get(signed(v), signed(v)) == signed(values[want[i]])


@pytest.mark.parametrize("distance,segments", [(0, 2), (1, 3), (2, 2), (5, 3)])
def test_other_distances(spark, distance, segments):
    r = random.Random(distance)
    values = []
    for _ in range(30):
        center = r.getrandbits(64)
        for _ in range(6):
            near = center
            for b in r.sample(range(64), r.randrange(distance + 3)):
                near ^= 1 << b
            values.append(near)
    values = sorted(set(values), key=signed)
    want = plain_components(values, distance)
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = joined([tuple(r) for r in simhash.links(prints, distance, segments).collect()])
    assert [got.get(signed(v), signed(v)) for v in values] == [signed(values[i]) for i in want]


def test_long_chain_of_links(spark):
    values = [0]
    for b in range(60):
        values.append(values[-1] ^ (1 << b))
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    assert {r["root"] for r in simhash.components(simhash.links(prints)).collect()} == {0}


def test_odd_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(rows)
    values = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(values, 3)
    least = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((r[0] or -1, signed(v), least.get(root) or -1) for r, v, root in zip(rows, values, roots))
    assert sorted((g["doc_id"] or -1, g["fp"], g["component_id"] or -1) for g in got) == want


def test_one_row_of_each_component_stays(spark):
    kept = simhash.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    rows = kept.collect()
    values = [plain_fingerprint(r["text"]) for r in rows]
    assert plain_components(values, 3) == list(range(len(rows)))
    before = odd_rows()
    roots = plain_components([plain_fingerprint(r[1]) for r in before], 3)
    least = {root: min((r[0] is None, r[0] or 0) for r, x in zip(before, roots) if x == root) for root in set(roots)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted(least.values())


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_copies_and_hot_group(spark):
    texts = [prose(1, 80)] * 300 + [prose(i, 80) for i in range(2, 40)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[i] == i for i in range(300, 338))


def test_popcount_of_negative_numbers():
    a = np.array([-1], np.int64)
    assert np.bitwise_count(a.view(np.uint64))[0] == 64


def test_few_rows_beside_a_crowded_neighbour_are_crowded_too(spark):
    r = random.Random(9)
    low, near = 0x10, 0x11  # the smaller segment value looks up the larger one
    values = [low | (r.getrandbits(32) << 32) for _ in range(300)] + [near | (r.getrandbits(32) << 32) for _ in range(3)]
    values += [values[0] ^ 1, values[1] ^ (1 << 40) ^ 1, values[-1] ^ (3 << 50)]
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    rows = simhash._indexed(prints, 2, 3)
    crowded = {tuple(x) for x in simhash._crowded(rows, 2, 3, 200).collect()}
    assert {(0, low), (0, near)} <= crowded
    split = simhash._split_crowds(rows, simhash._crowded(rows, 2, 3, 200), 2, 3)
    most = split.groupBy("seg", "value", "sub", "subvalue").count().agg({"count": "max"}).first()[0]
    assert most <= 200
    want = plain_components(values, 3)
    got = joined([tuple(x) for x in simhash.links(prints, 3, 2, 200).collect()])
    for i, v in enumerate(values):
        mine = [signed(values[k]) for k in range(len(values)) if want[k] == want[i]]
        assert got.get(signed(v), signed(v)) == min(mine)
