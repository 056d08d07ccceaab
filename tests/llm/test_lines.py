import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from civiclink.llm import lines

from .cases import empty, frame, odd, odd_rows, prose


def shared(n, words=12, seed=1000):
    return [prose(seed + i, words) for i in range(n)]


def test_patience_is_a_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randrange(12) for _ in range(r.randrange(20))]
        b = [r.randrange(12) for _ in range(r.randrange(20))]
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    a = list(range(30))
    assert lines.patience(a, [99, *a[:10], 98, 97, *a[10:], 96]) == [(i, i + 1 if i < 10 else i + 3) for i in range(30)]


def test_longest_increasing():
    r = random.Random(2)
    for _ in range(100):
        values = r.sample(range(30), 8)
        got = lines._increasing(list(enumerate(values)))
        best = max(
            (sum(1 for _ in c) for c in ([values[i] for i in range(8) if m >> i & 1] for m in range(256)) if c == sorted(c)), default=0
        )
        assert len(got) == best and [j for _, j in got] == sorted(j for _, j in got)


@pytest.mark.parametrize("rare", [8, 1])
def test_planted_passages_go_from_later_documents(spark, rare):
    passage = shared(6)
    texts = ["\n".join([prose(i, 15), prose(i + 500, 9), *(["", *passage] if i % 3 == 0 else []), prose(i + 900, 11)]) for i in range(60)]
    texts.append("\n".join([passage[2], prose(77, 30)]))  # one shared line is no block
    texts.append("\n".join(passage[:3]))  # 36 words only
    rows = {r["doc_id"]: r for r in lines.line_dedup(frame(spark, texts).repartition(3), rare=rare).collect()}
    for i in range(62):
        if 0 < i < 60 and i % 3 == 0:
            assert (rows[i]["removed"], rows[i]["lines_removed"], rows[i]["words_removed"]) == ("2:8", 6, 72)
        else:
            assert rows[i]["removed"] == "" and rows[i]["words_removed"] == 0
    out = {r["doc_id"]: r["text"] for r in lines.without_common_blocks(frame(spark, texts), rare=rare).collect()}
    for i in range(62):
        if 0 < i < 60 and i % 3 == 0:
            assert out[i] == "\n".join([prose(i, 15), prose(i + 500, 9), "", prose(i + 900, 11)])
        else:
            assert out[i] == texts[i]


def test_frequent_lines_inside_a_block(spark):
    common = "this line stands in every document of the whole corpus we have here"
    passage = shared(5)
    body = [*passage[:2], common, *passage[2:]]
    texts = ["\n".join([common, prose(i, 20)]) for i in range(40)] + ["\n".join(body), prose(5000, 4) + "\n" + "\n".join(body)]
    rows = {r["doc_id"]: r for r in lines.line_dedup(frame(spark, texts)).collect()}
    assert rows[41]["removed"] == "1:7" and all(rows[i]["removed"] == "" for i in range(41))


def test_block_of_frequent_lines_first_seen_in_different_documents(spark):
    passage = shared(6)
    texts = [f"{prose(i, 9)}\n{passage[i % 6]}" for i in range(60)] + ["\n".join(passage), prose(900, 8) + "\n" + "\n".join(passage)]
    rows = {r["doc_id"]: r for r in lines.line_dedup(frame(spark, texts), rare=1).collect()}
    assert rows[61]["removed"] == "1:7" and all(rows[i]["removed"] == "" for i in range(61))


def test_runs_are_the_shortest_that_reach_the_words():
    r = random.Random(6)
    for _ in range(50):
        words = [r.randrange(1, 30) for _ in range(r.randrange(12))]
        hashes = np.arange(1, len(words) + 1, dtype=np.uint64)
        want = []
        for i in range(len(words)):
            ends = [j for j in range(i + 1, len(words) + 1) if sum(words[i:j]) >= 50]
            if ends:
                want.append(xxhash.xxh64_intdigest(hashes[i : ends[0]].tobytes()))
        assert lines.runs(hashes, words, 50) == want


def test_repeated_and_moved_passages_go(spark):
    """Passages the earlier document has elsewhere, or the later one has twice."""
    p, q, s = shared(6), shared(5, seed=2000), shared(3, seed=3000)
    holders = [f"{prose(i, 9)}\n{x}" for i, x in enumerate(s)]
    for earlier, later, removed in [
        ([s[0], *p, s[2]], [*p, s[1], *p], "0:6,7:13"),
        (p, [*p, *p], "0:12"),
        ([*p, *q], [*q, *p], "0:11"),
    ]:
        texts = [*holders, "\n".join(earlier), "\n".join(later)]
        rows = {r["doc_id"]: r["removed"] for r in lines.line_dedup(frame(spark, texts)).collect()}
        assert [rows[i] for i in range(5)] == ["", "", "", "", removed]


def test_no_common_block_is_left():
    r = random.Random(8)
    for _ in range(300):
        size = lambda h: 5 + 7 * h % 23
        a, b = ([(i, h, size(h)) for i, h in enumerate(r.choices(range(6), k=r.randrange(25))) if r.random() > 0.1] for _ in range(2))
        got = lines.blocks(a, b, 50)
        gone = {i for x, y in got for i in range(x, y)}
        runs = lambda doc: {tuple(x[1] for x in p[i:j]) for p in lines._pieces(doc, set()) for i in range(len(p)) for j in range(i + 1, len(p) + 1)}  # noqa: E731, B023
        long = {x for x in runs(a) if sum(map(size, x)) >= 50}
        assert not long & runs([x for x in b if x[0] not in gone])
        inside = {p[k][0] for p in lines._pieces(b, set()) for i in range(len(p)) for j in range(i + 1, len(p) + 1) if tuple(x[1] for x in p[i:j]) in long for k in range(i, j)}
        assert gone <= inside


def test_every_removed_line_stays_somewhere(spark):
    r = random.Random(4)
    pool = shared(30, 20)
    texts = []
    for i in range(80):
        a, b = r.randrange(25), r.randrange(2, 9)
        texts.append("\n".join([prose(i, 8), *pool[a : a + b], prose(i + 300, 8), *pool[(a * 7) % 25 :][:4]]))
    out = lines.without_common_blocks(frame(spark, texts).repartition(4))
    kept = {x for r in out.collect() for x in (r["text"] or "").split("\n")}
    assert {x for t in texts for x in t.split("\n")} <= kept
    assert sum(len(r["text"]) for r in out.collect()) < sum(map(len, texts))


def test_odd_rows(spark):
    docs = odd(spark)
    got = lines.line_dedup(docs).collect()
    assert len(got) == len(odd_rows())
    cut = [r for r in got if r["removed"]]
    # 2 repeats 1, one of the two null ids and one of the rows of 12 repeat a row.
    assert sorted(str(r["doc_id"]) for r in cut) == ["12", "2"] and all(r["lines_removed"] == r["n_lines"] == 1 for r in cut)
    out = lines.without_common_blocks(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows())
    want = Counter(r[1] or "" for r in odd_rows()) - Counter([prose(2, 60), prose(4, 50)]) + Counter(["", ""])
    assert Counter(r["text"] or "" for r in out.collect()) == want


def test_empty_table(spark):
    assert lines.line_dedup(empty(spark)).count() == 0
    assert lines.without_common_blocks(empty(spark)).count() == 0
