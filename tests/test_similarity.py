import random

import pytest

from civiclink.functions import similarity as s


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("ABC D", k=rng.randrange(0, 12))) for _ in range(2))
        assert s.lcs_length(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("BONINLA", "BONINAL", 600 / 7),
        ("BONINLA", "OLINDINA", 200 / 3),
        ("SAO PAULO", "PAULO SAO", 95.0),
        ("AB", "AB CDE", 90.0),
        ("", "X", 0.0),
        ("SMALL RING", "SMALL RING QX", 95.0),
        ("KZV", "ABCDEF", 0.0),
    ],
)
def test_weighted_ratio_by_hand(a, b, score):
    assert s.weighted_ratio(a, b) == pytest.approx(score)
    assert s.weighted_ratio(b, a) == pytest.approx(score)


def test_block_keeps_every_top_name():
    rng = random.Random(3)
    words = ["SAO", "JOAO", "RIO", "BOA", "VISTA", "NOVA", "A", "LAGOA", "DO", "SUL"]
    names = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(80)})
    block = s.NameBlock(names)
    for _ in range(200):
        query = " ".join(rng.choices(words + ["JOA", "VISAT", "XQ"], k=rng.randrange(1, 5)))
        want = sorted((s.weighted_ratio(query, n) for n in names), reverse=True)[:5]
        got = [v for v, _ in sorted(block.best(query, [1] * len(names), 5), reverse=True)[:5]]
        assert got == pytest.approx(want)
